"""MinHash near-duplicates with an LSH forest.

Each text is a set of word shingles and gets TREES signature orders of LANES 16-bit minhashes each. In
every order texts are sorted by signature and a text's candidates are its neighbours that share a prefix of
at least LEAST lanes. The depth adapts by region: sparse regions pair at the least depth, and in dense ones
only the neighbours with the longest common prefix come within the window; regions too large for one task are
sorted apart by longer prefixes. Every text of a dense region is also paired with the region's pivot, the text
whose signatures are the most common ones, so a large group of copies of one text hangs together whatever its
size. Copies of equal word sequences are folded to one content first, pairs whose whole signatures rule the
similarity out by MARGIN standard deviations are dropped before any text is moved, and candidates inside one
component are not looked at again. All links are confirmed on the full shingle sets.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle, its whole word sequence; a row with a null id has no component and is
kept; rows that repeat an id are one row each, linked by their texts; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.byte_words import ASCII_LOW, Words, column_bytes, mixed, slices
from entrack.llm.common import HOT_ROWS, MOST_HOT, Scratch, salted_join, table
from entrack.llm.components import components

TREES, LANES, LEAST, WINDOW, DENSE = 16, 8, 3, 6, 12
#: Pairs are dropped when so many standard deviations of the signature's estimate lie between it and the bound.
MARGIN = 6.0
#: Ids of the texts to compare are broadcast up to so many rows; beyond, the join is a shuffle.
BROADCAST_ROWS = 500_000
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(8)
_MULTIPLY = _rng.integers(0, 2**63, TREES * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, TREES * LANES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text, A-Z lower-cased."""
    words = Words(data, offsets, lower=True)
    n = max(0, len(words.hashes) - width + 1)
    rolled = words.hashes[:n].copy()
    for k in range(1, width):
        rolled = rolled * _ROLL + words.hashes[k : n + k]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(rolled[a : b - width + 1]))
        else:
            total = np.full(min(1, b - a), np.uint64(b - a))
            for h in words.hashes[a:b]:
                total = mixed(total * _ROLL + h)
            found.append(total)
    return found


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * 2 longs; each tree's LANES minhashes, 16 bits each, the first lane highest."""
    least = np.full(TREES * LANES, np.uint64(2**64 - 1))
    for lo in range(0, len(hashes), 512):
        part = hashes[lo : lo + 512, None] ^ _FLIP[None, :]
        part *= _MULTIPLY[None, :]
        least = np.minimum(least, part.min(axis=0))
    lanes = (mixed(least) >> np.uint64(48)).reshape(TREES * 2, 4)
    packed = (lanes[:, 0] << np.uint64(48)) | (lanes[:, 1] << np.uint64(32)) | (lanes[:, 2] << np.uint64(16)) | lanes[:, 3]
    return packed.view(np.int64)


_SKETCH = "doc_id long, text_key long, k1 long, k2 long, n_shingles long, sig array<long>"


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                sets = shingle_sets(data, offsets, width)
                low = data.tobytes().translate(ASCII_LOW)
                keys = [hashlib.blake2b(b" ".join(low[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                sizes = [len(s) for s in sets]
                signs = np.concatenate([signature(s) for s in sets if len(s)]) if any(sizes) else np.zeros(0, np.int64)
                places = np.concatenate([[0], np.cumsum([TREES * 2 * (n > 0) for n in sizes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(places), pa.array(signs))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes, pa.int64()), lists], ["doc_id", "text_key", "k1", "k2", "n_shingles", "sig"])

    return run


_PAIR = "a long, b long, near boolean"


def _neighbours(window: int, share: int):
    """Pairs of rows near each other in the sorted order of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "tree", "hi", "id", "n")}
            old = 0
            if held is not None:
                old = len(held["id"])
                rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
            deal, tree, hi, ids, n = rows.values()
            for step in range(1, window + 1):
                i = np.arange(max(0, old - step), len(ids) - step)
                j = i + step
                ok = (j >= old) & (deal[i] == deal[j]) & (tree[i] == tree[j]) & (((hi[i] ^ hi[j]) >> (64 - 16 * LEAST)) == 0) & (ids[i] != ids[j])
                ok &= 100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                if len(i):
                    near = (step == 1) & (tree[i] == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(near)], ["a", "b", "near"])
            held = {c: x[-window:] for c, x in rows.items()}

    return run


def _dealt(trees: DataFrame, total: int) -> DataFrame:
    """Adds ``deal``, the group that is sorted as one: a prefix of LEAST lanes, a longer one in large regions.

    Of texts that share six lanes and are still too many for one task, parts are sorted apart by a hash of
    their id; such texts meet in their pivot. Groups of more than ``bound`` rows: MOST_HOT at most.
    """
    bound = max(HOT_ROWS, total // MOST_HOT)
    shallow, deep = F.shiftright("hi", 64 - 16 * LEAST), F.shiftright("lo", 32)
    large = trees.groupBy("tree", shallow.alias("top")).agg(F.count("*").alias("many")).where(F.col("many") > bound).select("tree", "top", F.lit(True).alias("large"))
    rows = trees.withColumn("top", shallow).withColumn("next", deep).join(F.broadcast(large), ["tree", "top"], "left")
    huge = rows.where("large").groupBy("tree", "hi", "next").agg(F.count("*").alias("many")).where(F.col("many") > bound)
    huge = huge.select("tree", "hi", "next", F.ceil(F.col("many") / F.lit(bound)).alias("salts"))
    rows = rows.join(F.broadcast(huge), ["tree", "hi", "next"], "left")
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long"))
    return rows.withColumn("deal", F.when(F.col("large"), F.xxhash64("tree", "hi", "next", salt)).otherwise(F.xxhash64("tree", "top")))


def candidates(reps: DataFrame, scratch: Scratch, share: int) -> DataFrame:
    """(a, b, near): distinct candidate pairs of contents; near ones are looked at first. ``reps``: id, n, sig."""
    trees = reps.select("id", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.col("sig")[2 * F.col("tree")].alias("hi"), F.col("sig")[2 * F.col("tree") + 1].alias("lo"), "id", "n"
    )
    trees = scratch.save(trees, "trees")
    total = trees.count()
    order = ["deal", "tree", "hi", "lo", "id"]
    in_order = _dealt(trees, total).select(*order, "n").repartition("deal").sortWithinPartitions(*order)
    found = in_order.mapInArrow(_neighbours(WINDOW, share), _PAIR)

    dense = trees.groupBy("tree", "hi").agg(F.count("*").alias("count")).where(F.col("count") > DENSE).withColumn("many", F.col("count"))
    members = scratch.save(salted_join(trees.drop("lo"), dense, ["tree", "hi"], ["id"], total, "count"), "members")
    central = members.groupBy("id").agg(F.sum("many").alias("central"))
    pivot = members.join(central, "id").groupBy("tree", "hi").agg(
        F.max(F.struct("central", (-F.col("id")).alias("minus_id"), F.col("n").alias("size"))).alias("p"), F.count("*").alias("count")
    )
    pivot = pivot.select("tree", "hi", (-F.col("p.minus_id")).alias("pivot"), F.col("p.central").alias("central"), F.col("p.size").alias("pivot_n"), "count")
    met = salted_join(members, pivot, ["tree", "hi"], ["id"], total, "count").where("id <> pivot")
    met = met.where(f"100 * least(n, pivot_n) >= {share} * greatest(n, pivot_n)")
    # of a text's pivots, one a tree at most, the most central one is near
    own = F.struct("central", (-F.col("pivot")).alias("minus"))
    met = met.groupBy("id").agg(F.max(own).alias("best"), F.collect_set(own).alias("all")).select("id", "best", F.explode("all").alias("p"))
    other = -F.col("p.minus")
    stars = met.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"), (F.col("p") == F.col("best")).alias("near"))
    pairs = scratch.save(found.unionByName(stars).groupBy("a", "b").agg(F.bool_or("near").alias("near")), "pairs")
    scratch.drop("trees", "members")
    return pairs


def least_lanes(share: int) -> int:
    """Equal lanes that a pair at the bound has but for MARGIN standard deviations."""
    p, n = share / 100, TREES * LANES
    return int(np.ceil(n * p - MARGIN * np.sqrt(n * p * (1 - p))))


def _promising(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, TREES * LANES) for c in ("left", "right"))
            ok = (left == right).sum(axis=1) >= least_lanes(share)
            yield batch.select(["a", "b", "near"]).filter(pa.array(ok))

    return run


def _with_both(pairs: DataFrame, of: DataFrame, column: str, total: int) -> DataFrame:
    """Adds to each pair the ``column`` of its two contents as left and right; a content may be in many pairs."""
    both = pairs.select("a", "b")
    for side, name in (("a", "left"), ("b", "right")):
        counts = both.groupBy(side).agg(F.count("*").alias("count"))
        own = of.select(F.col("id").alias(side), F.col(column).alias(name)).join(counts, side)
        pairs = salted_join(pairs, own, [side], ["b" if side == "a" else "a"], total, "count")
    return pairs


def _confirm(width: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            if doc not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                kept[doc] = shingle_sets(data, np.array([0, len(data)], np.int64), width)[0]
            return kept[doc]

        for batch in batches:
            rows = []
            for a, b, left, right in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                x, y = of(a, left), of(b, right)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= share * (len(x) + len(y) - both):
                    rows.append((a, b))
            if rows:
                u, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row of docs; text_key is the xxhash64 of the text.

    Two texts are linked when 100 * |A & B| >= share * |A | B| on their sets of ``width``-word shingles.
    Signature depths suit a share of 80 or more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    sketches = scratch.save(rows.mapInArrow(_sketch(width), _SKETCH), "sketches")

    usable = sketches.where("doc_id is not null and n_shingles > 0")
    contents = usable.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    contents = contents.select("k1", "k2", "least.*", "copies", "n", "sig")
    # written once, so ids stay what they are
    contents = scratch.save(contents.withColumn("id", F.monotonically_increasing_id()), "contents")
    pairs = candidates(contents.select("id", "n", "sig"), scratch, share)

    def confirmed(some: DataFrame, name: str) -> DataFrame:
        wanted = some.select(F.col("a").alias("id")).union(some.select(F.col("b").alias("id"))).distinct()
        wanted = scratch.save(contents.join(wanted, "id").select("id", "doc_id", "text_key"), f"wanted-{name}")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = scratch.save(rows.join(wanted, ["doc_id", "text_key"]).groupBy("id").agg(F.first("text").alias("text")), f"texts-{name}")
        return _with_both(some.select("a", "b"), texts, "text", some.count()).mapInArrow(_confirm(width, share), "u long, v long")

    def promising(some: DataFrame, name: str) -> DataFrame:
        return scratch.save(_with_both(some, contents, "sig", some.count()).mapInArrow(_promising(share), _PAIR), name)

    near = promising(pairs.where("near"), "promising-near")
    links = scratch.save(confirmed(near, "near"), "links-near")
    first = scratch.save(components(links, scratch, "near"), "components-near")
    of_a = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    open_pairs = pairs.where("not near").join(of_a, "a", "left").join(of_b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "near")
    rest = promising(scratch.save(open_pairs, "open"), "promising-open")
    rest = scratch.save(confirmed(rest, "open"), "links-rest")
    joined = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest)
    final = scratch.save(components(joined, scratch, "all"), "components-all")

    placed = contents.select("k1", "k2", "id", "doc_id", "copies").join(final, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("count"))
    named = salted_join(placed, least, ["component"], ["id"], contents.count(), "count")
    moved = scratch.save(named.where("copies > 1 or component_id <> doc_id").select("k1", "k2", "component_id", "copies"), "moved")
    scratch.drop("pairs", "promising-near", "wanted-near", "texts-near", "links-near", "components-near", "open", "promising-open", "wanted-open", "texts-open", "links-rest", "components-all", "contents")
    found = salted_join(sketches.select("doc_id", "text_key", "k1", "k2", "n_shingles"), moved, ["k1", "k2"], ["doc_id"], moved.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0], "copies", "left")
    return found.select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), share=85).drop("text_key")


ORACLE_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM tokens
), sizes AS (
  SELECT t.doc_id, count(s.s) AS n FROM tokens t LEFT JOIN shingles s USING (doc_id) GROUP BY t.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sizes
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""
