"""Mixing sources to target weights by hash-threshold histograms.

Each source's share of the words is set by weights, bounded by how often a document may repeat. A source then gives
all of its documents a whole number of times, and some of them once more: those whose hash lies below a threshold.
Thresholds come from histograms: words are summed by source and hash bucket, the bucket in which the budget ends is
found from running sums, and only that bucket is cut finer, until it holds one hash. Nothing is sorted, and the mix is a
filter on the hash, the same in every run.

The document at which the budget ends is left out; where more than ``near`` of the target is still open, the
search goes on above it among the documents that fit into what is open. At last, where nothing fits, the smallest
document left is taken if it leaves less over than is open. Documents are taken whole.

Defined cases: a null source is a source of its own; a null or empty text has no words and takes nothing; a source
without words has the target 0; rows alike in id and text have one hash and go together; ids may be null or repeat; an
empty table gives an empty result. Texts count whole, whatever their length. Columns that are not named in the
call are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.llm.common import WORD_PATTERN, Scratch, salted_join, table
from entrack.llm.places import placed

WEIGHTS, SHARE, MOST_REPEATS = (3, 1, 2), 1.5, 2.0
#: Open part of a target with which a source is done.
NEAR = 0.001
#: A hash has so many bits; each histogram cuts a bucket by LEVEL_BITS more.
HASH_BITS, LEVEL_BITS = 48, 12
_END = 1 << HASH_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(*parts: Column, seed: str = "") -> Column:
    """48 bits of the digest of the parts; nulls are dashes."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, words, n): share of all words by weight, at most ``most`` times the source's own.

    Weights go to the sources in order of their names, nulls last, and repeat. What a bound cuts off is shared again
    among the others until none is above; the only value held between the rounds is the words per weight.
    """
    ranked = placed(sources.withColumn("group", F.lit(0)).withColumn("unnamed", F.col("source").isNull()), "group", ["unnamed", "source"], scratch, "ranks")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = scratch.save(ranked.select("source", "words", "n", weight.alias("weight")), "weighted")
    bound, unit, capped = F.col("words") * most, 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > bound
        budget, held, open_weight, n = ranked.agg(F.sum("words") * share, F.sum(F.when(over, bound).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if n <= capped or not open_weight:
            break
        unit, capped = (budget - held) / open_weight, n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(unit), bound)).drop("weight")


def _crossed(rows: DataFrame, state: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(source, upto, took): the first hash with which the rows' running words exceed ``gap``, and the words before it.

    ``rows``: source, words, h and gap, the same for all rows of a source. A source whose rows all fit gets no row.
    """
    found, level = None, 0
    spent = state.select(F.col("source").alias("s"), "gap", F.lit(0).cast("long").alias("spent"))
    while True:
        level += 1
        bucket = F.shiftright("h", HASH_BITS - LEVEL_BITS * level)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("words").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.join(spent, F.col("source").eqNullSafe(F.col("s"))).withColumn("after", F.sum("words").over(run) + F.col("spent"))
        over = F.when(F.col("after") > F.col("gap"), F.struct("bucket", (F.col("after") - F.col("words")).alias("before"), "lo", "hi"))
        ends = sums.groupBy("source").agg(F.min(over).alias("e")).where("e is not null").select("source", "e.*")
        ends = scratch.save(ends, f"{label}-ends-{level}")
        done = ends.where("lo = hi").select("source", F.col("lo").alias("upto"), F.col("before").alias("took"))
        found = done if found is None else found.unionByName(done)
        wide = ends.where("lo < hi").select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("before").alias("spent"))
        if wide.isEmpty():
            return found
        inside = rows.join(wide.drop("spent"), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("b"))).select(*rows.columns)
        rows = scratch.save(inside, f"{label}-rows-{level}")
        spent = wide.join(state.select("source", "gap"), F.col("source").eqNullSafe(F.col("s"))).select("s", "gap", "spent")


def thresholds(sized: DataFrame, plan: DataFrame, scratch: Scratch, total: int, near: float = NEAR) -> DataFrame:
    """(source, above, upto, most): rows with above < h < upto and at most ``most`` words are taken once more.

    ``sized``: key, words, h; ``plan``: source, key, n, target, rest. Intervals of one source do not meet.
    """
    state = scratch.save(plan.where("rest > 0").select("source", "key", "n", "target", F.col("rest").alias("gap"), F.lit(-1).cast("long").alias("above")), "state-0")
    cuts = scratch.save(state.select("source", "key", "above", F.col("above").alias("upto"), F.lit(0).cast("long").alias("most")).where("false"), "cuts-0")
    again = 0
    while not state.isEmpty():
        again += 1
        fits = salted_join(sized, state.select("key", "n", "source", "gap", "above"), ["key"], ["h"], total).where((F.col("h") > F.col("above")) & (F.col("words") <= F.col("gap")))
        fits = scratch.save(fits.select("source", "words", "h"), f"fits-{again}")
        ends = _crossed(fits, state, scratch, f"pass-{again}").select(F.col("source").alias("s"), "upto", "took")
        moved = state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        cut = moved.select("source", "key", "above", F.coalesce("upto", F.lit(_END)).alias("upto"), F.floor("gap").alias("most"))
        cuts = scratch.save(cuts.unionByName(cut), f"cuts-{again}")
        left = moved.where("upto is not null").select("source", "key", "n", "target", (F.col("gap") - F.col("took")).alias("gap"), F.col("upto").alias("above"))
        state = scratch.save(left.where(F.col("gap") > F.col("target") * near), f"state-{again}")
    return scratch.save(cuts.unionByName(_last(sized, plan, cuts, total, near)), "cuts")


def _chosen(cuts: str = "cuts") -> Column:
    return F.exists(cuts, lambda c: (F.col("h") > c["above"]) & (F.col("h") < c["upto"]) & (F.col("words") <= c["most"]))


def _per_source(plan: DataFrame, cuts: DataFrame) -> DataFrame:
    """The plan with each source's intervals, of which there are as many as passes."""
    lists = cuts.groupBy("key").agg(F.collect_list(F.struct("above", "upto", "most")).alias("cuts"))
    empty = F.array().cast("array<struct<above: bigint, upto: bigint, most: bigint>>")
    return plan.join(lists, "key", "left").withColumn("cuts", F.coalesce("cuts", empty))


def _last(sized: DataFrame, plan: DataFrame, cuts: DataFrame, total: int, near: float) -> DataFrame:
    """The interval of the smallest row left, where taking it comes nearer to the target."""
    ready = _per_source(plan.where("rest > 0"), cuts).select("source", "key", "n", "target", "rest", "cuts")
    rows = salted_join(sized, ready, ["key"], ["h"], total).withColumn("in", _chosen())
    units = rows.groupBy("key", "source", "target", "rest", "h").agg(F.sum("words").alias("words"), F.max("words").alias("most"), F.max("in").alias("in"))
    best = units.groupBy("key", "source", "target", "rest").agg(
        F.sum(F.when(F.col("in"), F.col("words")).otherwise(0)).alias("took"), F.min(F.when(~F.col("in") & (F.col("words") > 0), F.struct("words", "h", "most"))).alias("least")
    )
    gap = F.col("rest") - F.col("took")
    nearer = (gap > F.col("target") * near) & (F.col("least.words") < 2 * gap)
    return best.where(nearer).select("source", "key", (F.col("least.h") - 1).alias("above"), (F.col("least.h") + 1).alias("upto"), F.col("least.most").alias("most"))


def mixed(docs: DataFrame, words: Column, source: str = "source", identity: tuple[str, ...] = ("doc_id", "text"), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: str = "", near: float = NEAR) -> DataFrame:
    """(first column of ``identity``, source, size, source_size, target, copies, taken) of every row.

    ``words``: a row's size; ``identity``: what tells documents apart. ``copies`` is how often the mix takes the row
    and ``taken`` its size times that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    named = docs.select(F.col(identity[0]).alias("id"), F.col(source).cast("string").alias("source"), words.alias("words"), row_hash(*[F.col(c) for c in identity], seed=seed).alias("h"))
    key = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))
    sized = scratch.save(named.withColumn("key", key).select("id", "key", "source", "words", "h"), "sized")
    sources = scratch.save(sized.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")), "sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    plan = targets(sources, scratch, weights, share, most)
    copies = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    plan = plan.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("words"))
    plan = scratch.save(plan.withColumn("key", key), "plan")
    rows = sized.select("id", "key", "words", "h")
    cuts = thresholds(rows.drop("id"), plan, scratch, total, near)
    ready = _per_source(plan.withColumnRenamed("words", "source_size"), cuts).select("key", "source", "n", "source_size", "target", "copies", "cuts")
    out = salted_join(rows, ready, ["key"], ["h"], total).withColumn("copies", F.col("copies") + _chosen().cast("long"))
    return out.select(F.col("id").alias(identity[0]), "source", F.col("words").alias("size"), "source_size", "target", "copies", (F.col("words") * F.col("copies")).alias("taken"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: The hash order is walked row by row: units are rows of one source and hash.
ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         CAST('0x' || substr(md5(concat(':', coalesce(CAST(doc_id AS VARCHAR), '-'), ':', coalesce(text, '-'))), 1, 12) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source
), fill AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS unit
  UNION ALL
  SELECT k + 1, (SELECT (sum(source_size) * 1.5 - sum(CASE WHEN weight * unit > 2 * source_size THEN 2 * source_size ELSE 0 END))
                        / CAST(sum(CASE WHEN weight * unit > 2 * source_size THEN 0 ELSE weight END) AS DOUBLE) FROM sources)
  FROM fill WHERE k < 30 AND (SELECT sum(source_size) FROM sources) > 0
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM (SELECT source, source_size, least(weight * (SELECT unit FROM fill ORDER BY k DESC LIMIT 1), 2.0 * source_size) AS target FROM sources)
), units AS (
  SELECT u.*, p.target, p.target - p.whole * p.source_size AS rest, row_number() OVER (PARTITION BY u.source ORDER BY h) AS r
  FROM (SELECT source, h, CAST(sum(size) AS BIGINT) AS total, max(size) AS size FROM sized GROUP BY source, h) u
  JOIN plan p ON p.source IS NOT DISTINCT FROM u.source
), walk AS (
  SELECT source, 0 AS r, CAST(NULL AS BIGINT) AS h, rest AS gap, rest AS most, rest <= 0 AS done, false AS took FROM units WHERE r = 1
  UNION ALL
  SELECT u.source, u.r, u.h,
         CASE WHEN NOT w.done AND u.size <= w.most AND u.total <= w.gap THEN w.gap - u.total ELSE w.gap END,
         CASE WHEN NOT w.done AND u.size <= w.most AND u.total > w.gap THEN w.gap ELSE w.most END,
         w.done OR (u.size <= w.most AND u.total > w.gap AND w.gap <= u.target * {NEAR}),
         NOT w.done AND u.size <= w.most AND u.total <= w.gap
  FROM walk w JOIN units u ON u.source IS NOT DISTINCT FROM w.source AND u.r = w.r + 1
), ends AS (
  SELECT source, min(gap) AS gap FROM walk GROUP BY source
), extra AS (
  SELECT u.source, u.h FROM units u JOIN walk w ON w.source IS NOT DISTINCT FROM u.source AND w.r = u.r JOIN ends e ON e.source IS NOT DISTINCT FROM u.source
  WHERE NOT w.took AND u.total > 0 AND u.rest > 0 AND e.gap > u.target * {NEAR}
  QUALIFY row_number() OVER (PARTITION BY u.source ORDER BY u.total, u.h) = 1 AND u.total < 2 * e.gap
), chosen AS (
  SELECT source, h FROM walk WHERE took UNION SELECT source, h FROM extra
)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.whole + CASE WHEN c.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source
LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM s.source AND c.h = s.h
"""
