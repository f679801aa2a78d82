"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Names, numbers and units become typed placeholders, so a question whose parameters were changed keeps its
template. Windows of WINDOW template tokens are hashed on both sides and joined; a document is matched to an
item when the windows cover at least ``share`` of the item's tokens and the slots agree along the best alignment
or along any other that covers the share alone: a document's slot value must stand for one value of the item, and
a name of the item for one name in the document. A number or unit that the item holds twice by chance may stand
for several; such coincidences are counted. Equal values are a copy, other consistent values a re-parameterised one.

Defined cases: null and empty texts match nothing on either side; an item of fewer than WINDOW tokens is one
window of its own length; windows with fewer than PLAIN ordinary tokens say nothing and are not used, so an
item without such a window, or of fewer than PLAIN tokens, matches nothing; a capitalised word that begins a
sentence counts as a name; rows that repeat an id or a text get the same matches once; a
null doc_id or item_id is kept as a null; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, fresh, table

WINDOW, PLAIN, SHARE = 8, 4, 0.5
#: Benchmark windows and flagged ids are broadcast up to so many rows; beyond, the join is a shuffle.
BROADCAST_ROWS = 500_000

#: Fixed: units that may follow a number.
UNITS = (
    "kg g mg lb oz t km m cm mm mi ft in l ml s ms min h hz khz mhz ghz kb mb gb tb w kw v a "
    "percent usd eur gbp dollars euros pounds hours minutes seconds days weeks months years"
).split()
_GAP = r"[\x20\x09-\x0D]"
# Repeated groups are possessive: Java walks these in a loop, others by recursion, which a run of some thousand names or
# numbers overflows. What may follow never begins inside a run, so giving back would find nothing more; and a
# number is only tried where its run begins, as all of its later digits lead to the same end.
_NAME = rf"(^|[\p{{Ll}},;:.!?]{_GAP}+)(\p{{Lu}}\p{{Ll}}+(?:{_GAP}\p{{Lu}}\p{{Ll}}+)*+)"
_NUMBER = r"([0-9](?<![0-9][.,:]?[0-9])[0-9]*+(?:[.,:][0-9]+)*+)"
_MEASURE = rf"{_NUMBER}{_GAP}?({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}|%|€|\$)($|[^\p{{L}}\p{{N}}])"
_TOKEN = r"[\p{L}\p{N}\x{1}\x{2}\x{3}]+"
_NUM, _UNIT, _NAM = "\x01", "\x02", "\x03"


def _stages(text: Column) -> tuple[Column, Column, Column]:
    """The text after names, after measures and after numbers were replaced."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "   ")
    named = F.regexp_replace(clean, _NAME, f"$1{_NAM}")
    measured = F.regexp_replace(named, f"(?i){_MEASURE}", f" {_NUM} {_UNIT} $3")
    return clean, named, F.regexp_replace(measured, _NUMBER, f" {_NUM} ")


def template(text: Column) -> Column:
    """The template tokens of a text."""
    return F.regexp_extract_all(F.lower(_stages(text)[2]), F.lit(_TOKEN), F.lit(0))


def slot_values(text: Column) -> Column:
    """Struct of the names, numbers and units of a text, each in order of their placeholders."""
    clean, named, _ = _stages(text)
    every = F.lit(f"(?i){_MEASURE}|{_NUMBER}")
    with_unit = F.regexp_extract_all(named, every, F.lit(1))
    alone = F.regexp_extract_all(named, every, F.lit(4))
    units = F.regexp_extract_all(named, F.lit(f"(?i){_MEASURE}"), F.lit(2))
    return F.struct(
        F.transform(F.regexp_extract_all(clean, F.lit(_NAME), F.lit(2)), F.lower).alias("names"),
        F.zip_with(with_unit, alone, lambda a, b: F.when(a != "", a).otherwise(b)).alias("numbers"),
        F.transform(units, F.lower).alias("units"),
    )


def _window_hashes(tokens: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens) - F.lit(width)),
        lambda i: F.xxhash64(*[F.get(tokens, i + F.lit(k)) for k in range(width)]),
    )


def _windows(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, pos, h): every window of the column ``w``."""
    tokens = F.col("w")
    hashes = F.when(F.size(tokens) >= width, _window_hashes(tokens, width))
    return rows.select(*keys, F.posexplode(hashes).alias("pos", "h"))


def _slots(tokens: Column, values: Column) -> Column:
    """Map from the places of placeholders to the values behind them."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))

    def of(sign: str, own: Column) -> Column:
        return F.transform(F.filter(places, lambda i: F.get(tokens, i) == sign), lambda i, nth: F.struct(i.alias("at"), F.get(own, nth).alias("value")))

    return F.map_from_entries(F.concat(of(_NUM, values["numbers"]), of(_UNIT, values["units"]), of(_NAM, values["names"])))


def _covered(at: Column, width: Column) -> Column:
    """How many tokens the windows at sorted places cover."""
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + p + width - F.greatest(s["end"], p)).alias("n"), (p + width).alias("end")),
    )["n"]


def leaked(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """(doc_id, text_key, item_id, matched_tokens, item_tokens, slots, reparameterised, coincidences) of every match."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    bench = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    bench = bench.withColumn("w", template(F.col("item_text"))).withColumn("v", slot_values(F.col("item_text")))
    bench = bench.select("item_id", "w", "v", F.size("w").alias("item_tokens"), F.sha1(F.coalesce("item_text", F.lit(""))).alias("item_key"))
    bench = scratch.save(bench.where("item_tokens > 0"), "items")
    widths = sorted(r[0] for r in bench.select(F.least(F.col("item_tokens"), F.lit(WINDOW))).distinct().collect())  # WINDOW values at most

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.col(text).alias("text")
    )
    templates = rows.select("doc_id", "text_key", template(F.col("text")).alias("w"))
    hits = None
    for width in widths:
        own = bench.where(F.least(F.col("item_tokens"), F.lit(WINDOW)) == width)
        plain = F.size(F.filter(F.slice("w", F.col("pos") + 1, width), lambda x: ~x.isin(_NUM, _UNIT, _NAM))) >= PLAIN
        marks = _windows(own, ["item_id", "item_key", "w", "item_tokens"], width).where(plain)
        marks = scratch.save(marks.select("item_id", "item_key", "item_tokens", F.col("pos").alias("item_pos"), "h"), f"marks-{width}")
        if marks.count() <= BROADCAST_ROWS:
            marks = F.broadcast(marks)
        found = _windows(templates, ["doc_id", "text_key"], width).join(marks, "h").withColumn("width", F.lit(width))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, text_key long, item_id long, matched_tokens long, item_tokens long, slots long, reparameterised boolean, coincidences long")
    pair = ["doc_id", "text_key", "item_id", "item_key", "item_tokens"]
    hits = scratch.save(hits.select(*pair, "item_pos", "width", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")

    # positions of one item: no more than it has tokens
    spots = hits.groupBy(*pair).agg(F.array_sort(F.collect_set("item_pos")).alias("at"), F.first("width").alias("width"))
    spots = spots.select(*pair, _covered(F.col("at"), F.col("width")).alias("matched_tokens")).where(F.col("matched_tokens") >= share * F.col("item_tokens"))
    lines = hits.groupBy(*pair, "shift").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item_pos")).alias("at"), F.first("width").alias("width"))
    line, wide = F.struct("shift", "n", "at", "width"), _covered(F.col("at"), F.col("width")) >= share * F.col("item_tokens")
    lines = lines.groupBy(*pair).agg(F.collect_list(F.when(wide, line)).alias("wide"), F.max_by(line, F.struct("n", -F.col("shift"))).alias("best"))
    lines = lines.select(*pair, F.array_distinct(F.concat(F.col("wide"), F.array("best"))).alias("b"))
    matches = scratch.save(_null_safe(spots, lines, pair), "matches")

    slotted = bench.where(F.exists("w", lambda x: x.isin(_NUM, _UNIT, _NAM))).select(
        F.col("item_key").alias("key"), F.col("item_id").alias("of_item"), F.col("w").alias("iw"), _slots(F.col("w"), F.col("v")).alias("iv")
    )
    if slotted.isEmpty():
        checked = matches.withColumn("slots", F.lit(0)).withColumn("reparameterised", F.lit(False)).withColumn("coincidences", F.lit(0)).withColumn("consistent", F.lit(True))
    else:
        checked = _with_slots(matches, slotted, rows, scratch)
    return checked.where("consistent").select(
        "doc_id", "text_key", "item_id", F.col("matched_tokens").cast("long"), F.col("item_tokens").cast("long"), F.col("slots").cast("long"), "reparameterised", F.col("coincidences").cast("long")
    )


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    other = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(other, condition).drop(*[f"r_{k}" for k in keys])


def _with_slots(matches: DataFrame, slotted: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds slots, consistent, reparameterised and coincidences of the alignment whose slot values agree best."""
    both = matches.join(slotted, F.col("item_key").eqNullSafe(F.col("key")) & F.col("item_id").eqNullSafe(F.col("of_item")), "left").drop("key", "of_item")
    both = scratch.save(both, "slotted")
    wanted = both.where("iw is not null").select("text_key").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = texts.select("text_key", template(F.col("text")).alias("dw"), slot_values(F.col("text")).alias("v"))
    texts = texts.select("text_key", _slots(F.col("dw"), F.col("v")).alias("dv"))
    joined = both.join(texts, "text_key", "left")

    def pairs(b: Column) -> Column:
        spots = F.array_distinct(F.flatten(F.transform(b["at"], lambda p: F.sequence(p, p + b["width"] - 1))))
        spots = F.filter(spots, lambda p: F.get(F.col("iw"), p).isin(_NUM, _UNIT, _NAM))
        return F.transform(spots, lambda p: F.struct(F.get(F.col("iw"), p).alias("k"), F.col("iv")[p].alias("i"), F.col("dv")[p + b["shift"]].alias("d")))

    none = F.array().cast("array<struct<k:string,i:string,d:string>>")
    paired = F.transform("b", lambda b: F.struct(b["shift"].alias("shift"), b["n"].alias("n"), F.when(F.col("iw").isNotNull(), pairs(b)).otherwise(none).alias("p")))

    def judged(x: Column) -> Column:
        kinds = F.array_distinct(x["p"])
        names = F.filter(kinds, lambda y: y["k"] == _NAM)
        apart = F.size(F.array_distinct(F.transform(kinds, lambda y: F.struct(y["k"], y["i"]))))
        one_each = F.size(F.array_distinct(F.transform(kinds, lambda y: F.struct(y["k"], y["d"])))) == F.size(kinds)
        named = F.size(F.array_distinct(F.transform(names, lambda y: y["i"]))) == F.size(names)
        return F.struct(
            F.exists(kinds, lambda y: ~y["i"].eqNullSafe(y["d"])).alias("reparameterised"),
            (F.size(kinds) - apart).alias("coincidences"),
            (-x["n"]).alias("order"),
            x["shift"].alias("shift"),
            F.size(x["p"]).alias("slots"),
            (one_each & named).alias("consistent"),
        )

    joined = joined.withColumn("paired", paired)
    agreeing = F.array_min(F.filter(F.transform("paired", judged), lambda x: x["consistent"]))
    joined = joined.withColumn("found", agreeing)
    return joined.select(
        *both.columns, "found.slots", "found.reparameterised", "found.coincidences", F.col("found").isNotNull().alias("consistent")
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns, whatever their names."""
    leak, leak_key = fresh(docs, "leak_id"), fresh(docs, "leak_key")
    bad = leaked(docs, items, doc_id, text).select(F.col("doc_id").alias(leak), F.col("text_key").alias(leak_key)).distinct()
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[doc_id].cast("long").eqNullSafe(F.col(leak)) & (key == F.col(leak_key)), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched_tokens", "item_tokens", "slots", "reparameterised").distinct()
