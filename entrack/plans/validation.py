"""Queries on guards, labels, codes, settings and seeded choices, on customer, part, events, labels and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.functions import text as X
from entrack.operators import validation as V
from entrack.operators.lineage import cut
from entrack.plans.evaluation import scored
from entrack.plans.sequences import events
from entrack.sources.tables import table

TAGS = ["foil", "small", "tilted", "blur", "stacked"]
PREFIXES = [("small ", "minor"), ("smal", "odd"), ("large", "major"), ("lime", "citrus"), ("li", "other li")]
KINDS = ["no-match", "wrong", "slow"]


def record_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows as records: first of an array, clean lines, whole positive numbers only, blank text as null."""
    p = table(spark, sf, "part").withColumn("raw", F.concat(F.lit(" "), "p_name", F.lit("\r\n"), "p_type", F.lit("\r")))
    sizes = F.when(F.col("p_size") > 5, F.array(F.col("p_size").cast("double"), F.lit(1.0)))
    return p.select(
        F.col("p_partkey").alias("id"), X.clean_lines(F.col("raw")).alias("text"), X.clean_lines(F.when(F.col("p_size") > 25, F.lit(" \r\n")).otherwise(F.col("p_brand"))).alias("brand"),
        F.get(sizes, 0).cast("long").alias("size"), F.transform(F.array("p_partkey", F.col("p_partkey") + 1), lambda x: x * 10).alias("item_ids"),
    )


def price_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Two prices as a struct, null where both are."""
    c = table(spark, sf, "customer")
    a, b = X.positive_price(F.col("c_acctbal").cast("string")), X.positive_price(F.when(F.col("c_nationkey") > 12, "n/a").otherwise(F.col("c_nationkey").cast("string")))
    pair = F.when(a.isNotNull() | b.isNotNull(), F.struct(a.alias("one"), b.alias("two")))
    return c.select("c_custkey", pair.isNull().alias("none"), pair["one"].alias("one"), pair["two"].alias("two"))


def pack_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), (F.col("conv_id") / F.when(F.col("turn") % 3 == 2, 2).otherwise(1)).cast("double").alias("id"), F.col("role").alias("name"), F.col("text").alias("desc"), F.lit(None).cast("string").alias("extra"))
    return V.parsed_pack(rows, 10).select("id", "name", F.length("desc").cast("long").alias("chars"))


def pack_too_small(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    rows = r.select(F.col("r_regionkey").alias("pos"), (F.col("r_regionkey") + 1).cast("double").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("desc"), F.lit(None).cast("string").alias("extra"))
    return V.parsed_pack(rows, 5000).select("id", "name")


def payload_all_or_nothing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders all of whose lines are valid; an order with one bad line or too many goes whole."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return V.all_or_nothing(l, ["l_orderkey"], (F.col("l_quantity") <= 45) & F.col("l_returnflag").isin("A", "N", "R"), 6).select("l_orderkey", "l_linenumber")


def settings_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored settings by user: known values stay, an old name is replaced, others fall to the default."""
    e = events(spark, sf)
    return e.select(
        "event_id", V.known_or(F.col("event_type"), ["click", "view", "buy"], "view", {"purchase": "buy"}).alias("mode"),
        F.coalesce(F.when(F.col("k") % 3 > 0, F.col("k") % 3 == 1), F.lit(True)).alias("label"),
    )


def log_guard(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    number = F.when(F.col("k") > 3, F.col("value"))
    entry = F.struct(F.col("user_id").cast("double").alias("entity_id"), F.col("value").alias("first"), number.alias("last"), F.lit(1.0).alias("appearances"))
    entries = F.when(F.col("k") != 7, F.when(F.col("k") > 50, F.array()).otherwise(F.array(entry)))
    log = F.struct(F.when(F.col("k") != 9, F.col("event_type")).alias("page"), F.col("at").alias("started"), F.col("event_type").alias("status"), entries.alias("entries"))
    return e.select("event_id", V.log_shape(log, ["click", "view", "purchase"]).alias("good"))


def first_known_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Of three candidates the first that is a known supplier and not the sentinel."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.max("l_partkey").alias("c"))  # noqa: E741
    each = l.select("l_orderkey", F.posexplode(F.array("c", F.when(F.col("a") % 5 == 0, -1).otherwise(F.col("a")), "b")).alias("at", "entity_id"))
    known = table(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("entity_id"))
    return each.where("entity_id <> -1").join(known, "entity_id", "left_semi").groupBy("l_orderkey").agg(F.min_by("entity_id", "at").alias("entity_id"))


def display_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    item = F.when(F.col("p_size") % 3 == 0, -(F.col("p_partkey") * 100 + F.col("p_size"))).otherwise(F.col("p_partkey"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.array(F.col("s_suppkey") * 7).alias("item_ids"))
    return p.join(known, "p_partkey", "left").select("p_partkey", V.display_id(item, F.col("item_ids")).alias("shown"))


def prefix_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(V.prefix_group(F.col("p_name"), PREFIXES, "rest").alias("group")).agg(F.count("*").alias("n"))


def sample_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with every side and fraction, and with every cover and share: derived ids."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("source"))
    text = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    cut = s.withColumn("side", text(["left", "top"])).withColumn("part", text(["0.25", "0.5", "0.75"])).withColumn("set", F.lit("cut"))
    cover = s.withColumn("side", text(["hand", "glare"])).withColumn("part", text(["0.1", "0.3"])).withColumn("set", F.lit("cover"))
    return cut.unionByName(cover).select("set", F.concat_ws("|", "source", "side", "part").alias("id"))


def answer_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    top, truth = F.when(F.col("k") % 7 > 0, F.col("k") % 7), F.when(F.col("event_type") != "view", F.col("user_id") % 7)
    got = e.select(V.answer_label(top, truth, F.col("value") >= 20).alias("label"))
    return got.groupBy("label").agg(F.count("*").alias("n"))


def decision_labels(spark: SparkSession, sf: str) -> DataFrame:
    e, k = events(spark, sf), F.col("k")
    label = V.decision_label(k % 11 == 3, F.when(k % 13 > 0, k % 5), F.col("value") >= 30, k % 2 == 0, k % 3 == 0, k % 7 == 0)
    return e.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def command_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes made of event rows: picks, ids, rejects, negatives and broken ones, tags split off."""
    e, k = events(spark, sf), F.col("k")
    what = F.when(k % 5 == 0, "x").when(k % 5 == 1, "neg").when(k % 5 == 2, F.concat(F.lit("id:"), "user_id")).when(k % 5 == 3, k.cast("string")).otherwise("what?")
    rest = F.when(k % 3 == 0, "").when(k % 3 == 1, " foil, held  small").otherwise(F.concat(F.lit(" "), "event_type"))
    code = F.when(k == 77, "broken").otherwise(F.concat(F.col("event_id").cast("string"), F.lit("="), what, rest))
    c = V.command(code, TAGS)
    return e.withColumn("c", c).select("event_id", "c.kind", "c.pick", F.col("c.id").alias("entity_id"), F.array_join("c.tags", ",").alias("tags"), "c.note")


def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that went well, look like a placeholder, or failed; a bad row fails alone."""
    v = table(spark, sf, "embeddings")
    vec = F.when(F.col("vec_id") % 17 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 19 > 0, F.col("embedding"))
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    flat = F.round(F.get(vec, 0).cast("double") / norm, 9) >= 0.25
    outcome = F.when(vec.isNull() | (F.size(vec) == 0), "failed").when(flat, "placeholder").otherwise("embedded")
    return v.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def report_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads made of events as JSON, parsed and rejected whole with the first reason."""
    e, k = events(spark, sf), F.col("k")
    png, jpeg = "iVBORw0KGgoAAAAA", "/9j/4AAQ"
    image = F.when(k % 7 == 0, "data:image/png;base64," + jpeg).when(k % 7 == 1, "nothing").when(k % 7 == 2, "data:image/jpeg;base64," + jpeg).otherwise("data:image/png;base64," + png)
    body = F.to_json(F.struct(
        F.when(k % 23 == 0, 2).otherwise(1).alias("v"), F.when(k % 19 == 0, "odd").when(k % 2 == 0, "no-match").otherwise("wrong").alias("kind"),
        F.when(k % 5 > 0, F.struct(F.when(k % 13 == 0, F.lit(1.5)).otherwise(F.col("user_id").cast("double")).alias("id"), F.col("event_type").alias("name"))).alias("shown"),
        F.when(k % 11 == 0, F.array(F.struct(F.lit(3.0).alias("id"), F.lit(" ").alias("name")))).alias("others"),
        F.when(k % 4 == 0, F.struct(F.when(k % 16 == 0, F.lit(-1.0)).otherwise(k.cast("double")).alias("id"), F.lit("mine").alias("name"))).alias("userCard"),
        F.when(k % 6 == 0, F.lit(" \r\n ")).otherwise(F.concat(F.lit(" seen\r\nat "), k.cast("string"), F.lit("\n"))).alias("comment"),
        F.when(k % 3 == 0, F.struct(F.when(k % 9 == 0, "ftp://a/b").otherwise("https://a.b/c?d").alias("url"), F.when(k % 12 == 0, F.lit(1e7)).otherwise(F.col("value") - 5).alias("time"))).alias("video"),
        F.when(k % 31 > 0, F.struct(F.when(k % 29 == 0, "x1").otherwise("1.2.3").alias("version"))).alias("app"), image.alias("image"),
    ))
    parsed = cut(e.select("event_id", body.alias("body"))).select("event_id", F.from_json("body", V.REPORT).alias("r"))
    told = parsed.select("event_id", V.report_fault(F.col("r"), KINDS).alias("reason"), V.report_fields(F.col("r")).alias("f"))
    return told.select("event_id", "reason", *[F.when(F.col("reason").isNull(), F.col(f"f.{c}")).alias(c) for c in ("user_entity", "comment", "second")])


def video_links(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    name = F.lpad(k.cast("string"), 11, "a")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?list=1&v="), name, F.lit("&x=1"))).when(k % 4 == 1, F.concat(F.lit("https://youtu.be/"), name, F.lit("?t=3")))
    url = url.when(k % 4 == 2, F.concat(F.lit("https://youtube.com/watch?v="), k.cast("string"))).otherwise(F.concat(F.lit("https://example.org/a`b|c/"), k.cast("string")))
    return p.select("p_partkey", V.video_link(url, F.when(k % 3 == 0, k)).alias("link"))


def negative_buckets(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumns({"failed": F.col("k") % 10 == 0, "sure": F.col("value") >= 30, "nothing": (F.col("value") < 5) & (F.col("k") % 10 > 0)})
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("failed")).alias("errors"), F.count_if(~F.col("failed") & F.col("sure")).alias("confident"), F.count_if("nothing").alias("nothing"))
    return g.withColumn("not_sure", F.col("n") - F.col("confident") - F.col("nothing") - F.col("errors"))


def full_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Right at the first and among the first five places, sure, surely wrong, failed; times of rows that ran."""
    e = scored(spark, sf).withColumn("place", F.col("k") % 9)
    ran = F.col("k") % 10 > 0
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(ran & (F.col("place") == 1)).alias("top1"), F.count_if(ran & F.col("place").between(1, 5)).alias("top5"), F.count_if(ran & (F.col("s1") >= 0.3)).alias("confident"),
        F.count_if(ran & (F.col("s1") >= 0.3) & (F.col("place") != 1)).alias("confident_wrong"), F.count_if(~ran).alias("errors"), F.round(F.percentile(F.when(ran, F.col("s1")), F.lit(0.5)), 6).alias("median"),
    )


def timing_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Median and ninth tenth, null for a group without a time."""
    p = F.percentile(F.when((F.col("value") < 60) & (F.col("user_id") % 4 > 0), F.col("value")), F.array(F.lit(0.5), F.lit(0.9)))
    return events(spark, sf).groupBy("user_id").agg(F.round(p[0], 6).alias("median"), F.round(p[1], 6).alias("p90"))


def confusion_missed(spark: SparkSession, sf: str) -> DataFrame:
    """Labels against decisions, the rows without a decision in a column of their own."""
    l = table(spark, sf, "labels").withColumn("found", F.when(F.col("doc_id") % 4 > 0, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)))  # noqa: E741
    return l.groupBy("toxic").agg(F.count_if(F.col("found") == 1).alias("as_toxic"), F.count_if(F.col("found") == 0).alias("as_clean"), F.count_if(F.col("found").isNull()).alias("missed"))


def direction_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted sum of directions, null where they cancel out."""
    turn = F.radians(F.col("k") * 90 % 360)
    g = events(spark, sf).groupBy("user_id").agg(F.round(F.sum(F.cos(turn) * F.col("value")), 6).alias("x"), F.round(F.sum(F.sin(turn) * F.col("value")), 6).alias("y"))
    holds = F.hypot("x", "y") > 1e-9
    return g.select("user_id", F.when(holds, F.col("x") + 0.0).alias("x"), F.when(holds, F.col("y") + 0.0).alias("y"))


def interference(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose three commonest values of k meet no other user's of the same day."""
    e = events(spark, sf).withColumn("day", F.floor(F.col("at") / 86400))
    n = e.groupBy("day", "user_id", "k").agg(F.count("*").alias("n"))
    w = Window.partitionBy("day", "user_id").orderBy(F.col("n").desc(), "k")
    top = n.withColumn("place", F.row_number().over(w)).where("place <= 3").select("day", "user_id", "k")
    shared = top.groupBy("day", "k").agg(F.count("*").alias("users")).where("users > 1").select("day", "k")
    bad = top.join(shared, ["day", "k"], "left_semi").select("day", "user_id").distinct()
    return top.select("day", "user_id").distinct().join(bad, ["day", "user_id"], "left_anti")


def spread_pick(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    return o.select("o_custkey", F.array_join(V.spread_places(F.col("n"), 5).cast("array<string>"), ",").alias("places"))


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred parts by their seeded draws: the same ones on every run and any number of machines."""
    p = table(spark, sf, "part").select("p_partkey", V.seeded_uniform(F.lit(7), F.col("p_partkey") + 1).alias("draw"))
    return p.orderBy("draw", "p_partkey").limit(100)


def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred parts that a seeded shuffle of all puts first, in its order."""
    return V.shuffled_sample(table(spark, sf, "part").select("p_partkey"), "p_partkey", 100, 7).select("p_partkey", "place")


def hash_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", V.text_seed(F.concat_ws("|", "p_name", "p_brand")).alias("seed"))


def spread_order(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in the order of mirrored bits: any beginning is spread over all of them."""
    return table(spark, sf, "supplier").select("s_suppkey", V.radical_inverse(F.col("s_suppkey"), 2).alias("place"))


def jittered_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Six whole seconds from 5 % to 95 % of each length, each moved by up to two fifths of the spacing."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 60).alias("length"), V.text_seed(F.concat(F.col("p_partkey").cast("string"), F.lit(":6"))).alias("seed"))
    each = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("m")).withColumn("step", F.lit(0.9) * F.col("length") / 6)
    at = F.lit(0.05) * F.col("length") + F.col("step") * (F.col("m") + 0.5) + (V.seeded_uniform(F.col("seed"), F.col("m") + 1) - 0.5) * 0.8 * F.col("step")
    return each.select("p_partkey", "m", F.greatest(F.lit(0), X.half_up(at)).cast("long").alias("at"))


def timing_map(spark: SparkSession, sf: str) -> DataFrame:
    """Times by step as a map: small ones dropped, one step renamed, read back by key."""
    e = events(spark, sf)
    m = F.create_map(F.lit("load"), F.col("value"), F.lit("embed"), F.col("k").cast("double"), F.lit("search"), F.col("value") / 2)
    kept = F.transform_keys(F.map_filter(m, lambda _, v: v >= 10), lambda k, _: F.when(k == "search", "find").otherwise(k))
    return e.withColumn("m", kept).select("event_id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("steps"), F.try_element_at("m", F.lit("find")).alias("find"), F.cardinality("m").alias("n"))


_ALL = (
    record_trim, price_pair, pack_parse, pack_too_small, payload_all_or_nothing, settings_merge, log_guard, first_known_entity, display_ids, prefix_groups, sample_expansion,
    answer_labels, decision_labels, command_codes, batch_outcomes, report_validation, video_links, negative_buckets, full_buckets, timing_stats, confusion_missed,
    direction_vote, interference, spread_pick, seeded_sample, seeded_shuffle, hash_seeds, spread_order, jittered_moments, timing_map,
)
QUERIES = {f.__name__: f for f in _ALL}

_E = "e AS (SELECT event_id, user_id, event_type, round(value, 6) AS value, round(epoch_us(ts) / 1e6, 6) AS tm, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_S = f"""{_E}, s AS (SELECT event_id, user_id, event_type, k, round(least(1.0, value / 100), 4) AS s1 FROM e)"""
_M = 4294967296


def _draw(seed: str, nth: str) -> str:
    """The seeded draw in DuckDB: whole numbers of 128 bits, reduced to 32."""
    t0 = f"(({seed})::HUGEINT + ({nth})::HUGEINT * 1831565813) % {_M}"
    steps = [f"a AS (SELECT *, CAST({t0} AS BIGINT) AS t0 FROM src)"]
    steps.append(f"b AS (SELECT *, CAST((xor(t0, t0 >> 15)::HUGEINT * (t0 | 1)::HUGEINT) % {_M} AS BIGINT) AS t1 FROM a)")
    steps.append(f"c AS (SELECT *, xor(t1, CAST((t1 + (xor(t1, t1 >> 7)::HUGEINT * (t1 | 61)::HUGEINT) % {_M}) % {_M} AS BIGINT)) AS t2 FROM b)")
    steps.append(f"d AS (SELECT *, xor(t2, t2 >> 14) / {_M}.0 AS draw FROM c)")
    return ", ".join(steps)


def _fnv(text: str) -> str:
    codes = f"list_prepend(2166136261::HUGEINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::HUGEINT))"
    return f"CAST(list_reduce({codes}, lambda h, x: (xor(h::BIGINT, x::BIGINT)::HUGEINT * 16777619) % {_M}) AS BIGINT)"


_WHAT = "CASE k % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'neg' WHEN 2 THEN 'id:' || user_id WHEN 3 THEN CAST(k AS VARCHAR) ELSE 'what?' END"
ORACLES = {
    "record_trim": "SELECT p_partkey AS id, p_name || chr(10) || p_type AS text, CASE WHEN p_size <= 25 THEN p_brand END AS brand, CASE WHEN p_size > 5 THEN p_size::BIGINT END AS size, [p_partkey * 10, p_partkey * 10 + 10] AS item_ids FROM part",
    "price_pair": "WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS one, CASE WHEN c_nationkey BETWEEN 1 AND 12 THEN c_nationkey::DOUBLE END AS two FROM customer) SELECT c_custkey, one IS NULL AND two IS NULL AS none, one, two FROM p",
    "pack_parse": """WITH r AS (SELECT conv_id * 100 + turn AS pos, conv_id / CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END AS id, role AS name, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS d FROM conversations)
SELECT id::BIGINT AS id, name, length(d) AS chars FROM r WHERE id = floor(id) AND id > 0 AND d <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1""",
    "pack_too_small": "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region WHERE false",
    "payload_all_or_nothing": "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY bool_and(l_quantity <= 45) OVER (PARTITION BY l_orderkey) AND count(*) OVER (PARTITION BY l_orderkey) <= 6",
    "settings_merge": f"WITH {_E} SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'click' THEN 'click' ELSE 'view' END AS mode, k % 3 <> 2 AS label FROM e",
    "log_guard": f"WITH {_E} SELECT event_id, k <> 9 AND k <> 7 AND event_type IN ('click', 'view', 'purchase') AND (k > 50 OR k > 3) AS good FROM e",
    "first_known_entity": """WITH l AS (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b, max(l_partkey) AS c FROM lineitem GROUP BY 1),
t AS (SELECT l_orderkey, 0 AS i, c AS x FROM l UNION ALL SELECT l_orderkey, 1, a FROM l WHERE a % 5 <> 0 UNION ALL SELECT l_orderkey, 2, b FROM l)
SELECT l_orderkey, arg_min(x, i) AS entity_id FROM t WHERE x IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) GROUP BY 1""",
    "display_ids": """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -(p_partkey * 100 + p_size) ELSE p_partkey END AS item FROM part)
SELECT p_partkey, CASE WHEN item <= -101 AND (-item) % 100 <> 0 THEN coalesce(s_suppkey * 7, item) ELSE item END AS shown FROM p LEFT JOIN supplier ON s_suppkey = p_partkey""",
    "prefix_groups": "SELECT CASE " + " ".join(f"WHEN starts_with(p_name, '{a}') THEN '{b}'" for a, b in PREFIXES) + " ELSE 'rest' END AS \"group\", count(*) AS n FROM part GROUP BY 1",
    "sample_expansion": """SELECT 'cut' AS "set", s_suppkey || '|' || x || '|' || y AS id FROM supplier, (SELECT unnest(['left', 'top']) AS x), (SELECT unnest(['0.25', '0.5', '0.75']) AS y)
UNION ALL SELECT 'cover', s_suppkey || '|' || x || '|' || y FROM supplier, (SELECT unnest(['hand', 'glare']) AS x), (SELECT unnest(['0.1', '0.3']) AS y)""",
    "answer_labels": f"""WITH {_E} SELECT CASE WHEN k % 7 = 0 THEN 'nothing' ELSE CASE WHEN value >= 20 THEN 'sure-' ELSE 'unsure-' END || CASE WHEN event_type = 'view' THEN 'noncard' WHEN k % 7 = user_id % 7 THEN 'right' ELSE 'wrong' END END AS label, count(*) AS n FROM e GROUP BY 1""",
    "decision_labels": f"""WITH {_E} SELECT CASE WHEN k % 13 = 0 THEN 'not-run' WHEN k % 11 = 3 THEN 'error' WHEN k % 5 = 0 THEN 'nothing' WHEN value >= 30 THEN CASE WHEN k % 2 = 0 THEN 'confident-back' ELSE 'confident' END
WHEN k % 3 = 0 THEN 'suggested' WHEN k % 7 = 0 THEN 'badge' WHEN k % 2 = 0 THEN 'unsure-back' ELSE 'unsure' END AS label, count(*) AS n FROM e GROUP BY 1""",
    "command_codes": f"""WITH {_E}, c AS (SELECT *, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'foil, held  small' ELSE event_type END AS rest, k % 5 AS r FROM e)
SELECT event_id, CASE WHEN k = 77 OR r = 4 THEN 'bad' WHEN r = 0 THEN 'reject' WHEN r = 1 THEN 'negative' WHEN r = 2 THEN 'identified' ELSE 'candidate' END AS kind,
  CASE WHEN k <> 77 AND r = 3 THEN k::BIGINT END AS pick, CASE WHEN k <> 77 AND r = 2 THEN user_id END AS entity_id,
  CASE WHEN k <> 77 AND r IN (2, 3) THEN CASE WHEN k % 3 = 1 THEN 'foil,small' ELSE '' END END AS tags,
  CASE WHEN k = 77 OR r = 4 THEN NULL WHEN r IN (2, 3) THEN CASE WHEN k % 3 = 1 THEN 'held' ELSE rest END WHEN r = 0 THEN CASE WHEN rest = '' THEN 'rejected' ELSE rest END ELSE CASE WHEN rest = '' THEN 'non-card' ELSE rest END END AS note FROM c""",
    "batch_outcomes": """SELECT CASE WHEN vec_id % 17 = 0 OR vec_id % 19 = 0 THEN 'failed' WHEN round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) >= 0.25 THEN 'placeholder' ELSE 'embedded' END AS outcome,
count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY 1""",
    "report_validation": f"""WITH {_E}, r AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'not a version 1 report' WHEN k % 19 = 0 THEN 'kind: unknown' WHEN k % 5 > 0 AND k % 13 = 0 THEN 'shown: not an entity'
WHEN k % 2 = 1 AND k % 5 = 0 THEN 'wrong: nothing shown' WHEN k % 11 = 0 THEN 'others: not an entity' WHEN k % 16 = 0 THEN 'userCard: not an entity' WHEN k % 9 = 0 THEN 'video: not an http(s) address'
WHEN k % 31 = 0 THEN 'app: missing' WHEN k % 29 = 0 THEN 'app.version: not a version number' WHEN k % 7 = 0 THEN 'image: not a PNG file' WHEN k % 7 = 1 THEN 'image: not a known data URL' END AS reason FROM e)
SELECT event_id, reason, CASE WHEN reason IS NULL AND k % 4 = 0 THEN k::BIGINT END AS user_entity, CASE WHEN reason IS NULL AND k % 6 > 0 THEN 'seen' || chr(10) || 'at ' || k END AS comment,
CASE WHEN reason IS NULL AND k % 3 = 0 AND k % 12 > 0 AND value >= 5 THEN CAST(floor(value - 5) AS BIGINT) END AS second FROM r""",
    "video_links": """WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 11, 'a') AS n, CASE WHEN p_partkey % 3 = 0 THEN '&t=' || p_partkey || 's' ELSE '' END AS t FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'https://www.youtube.com/watch?v=' || n || t WHEN p_partkey % 4 = 2 THEN '`https://youtube.com/watch?v=' || p_partkey || '`' ELSE '`https://example.org/a%60b%7Cc/' || p_partkey || '`' END AS link FROM p""",
    "negative_buckets": f"""WITH {_E}, g AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k % 10 = 0) AS errors, count(*) FILTER (WHERE k % 10 > 0 AND value >= 30) AS confident, count(*) FILTER (WHERE k % 10 > 0 AND value < 5) AS nothing FROM e GROUP BY 1)
SELECT *, n - confident - nothing - errors AS not_sure FROM g""",
    "full_buckets": f"""WITH {_S} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k % 10 > 0 AND k % 9 = 1) AS top1, count(*) FILTER (WHERE k % 10 > 0 AND k % 9 BETWEEN 1 AND 5) AS top5, count(*) FILTER (WHERE k % 10 > 0 AND s1 >= 0.3) AS confident,
count(*) FILTER (WHERE k % 10 > 0 AND s1 >= 0.3 AND k % 9 <> 1) AS confident_wrong, count(*) FILTER (WHERE k % 10 = 0) AS errors, round(quantile_cont(CASE WHEN k % 10 > 0 THEN s1 END, 0.5), 6) AS median FROM s GROUP BY 1""",
    "timing_stats": f"WITH {_E}, t AS (SELECT user_id, CASE WHEN value < 60 AND user_id % 4 > 0 THEN value END AS v FROM e) SELECT user_id, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM t GROUP BY 1",
    "confusion_missed": "SELECT toxic, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 3 = 0) AS as_toxic, count(*) FILTER (WHERE doc_id % 4 > 0 AND doc_id % 3 > 0) AS as_clean, count(*) FILTER (WHERE doc_id % 4 = 0) AS missed FROM labels GROUP BY 1",
    "direction_vote": f"""WITH {_E}, g AS (SELECT user_id, round(sum(cos(radians(k * 90 % 360)) * value), 6) AS x, round(sum(sin(radians(k * 90 % 360)) * value), 6) AS y FROM e GROUP BY 1)
SELECT user_id, CASE WHEN sqrt(x * x + y * y) > 1e-9 THEN x END AS x, CASE WHEN sqrt(x * x + y * y) > 1e-9 THEN y END AS y FROM g""",
    "interference": f"""WITH {_E}, n AS (SELECT CAST(floor(tm / 86400) AS BIGINT) AS day, user_id, k, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT day, user_id, k FROM n QUALIFY row_number() OVER (PARTITION BY day, user_id ORDER BY n DESC, k) <= 3)
SELECT DISTINCT day, user_id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b JOIN t m ON m.day = b.day AND m.k = b.k WHERE m.day = a.day AND m.user_id = a.user_id AND b.user_id <> a.user_id)""",
    "spread_pick": """WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n <= 5 THEN array_to_string(range(0, n), ',') ELSE array_to_string(list_sort(list_distinct(list_transform(range(0, 5), lambda i: CAST(floor(i * (n - 1) / 4 + 0.5) AS BIGINT)))), ',') END AS places FROM o""",
    "seeded_sample": f"WITH src AS (SELECT p_partkey FROM part), {_draw('7', 'p_partkey + 1')} SELECT p_partkey, draw FROM d ORDER BY draw, p_partkey LIMIT 100",
    "seeded_shuffle": f"""WITH RECURSIVE n AS (SELECT count(*) AS n, list(p_partkey ORDER BY p_partkey) AS pool FROM part), src AS (SELECT unnest(range(1, n)) AS i, n FROM n), {_draw("7", "n - i")},
j AS (SELECT i, CAST(floor(draw * (i + 1)) AS BIGINT) AS j FROM d),
r AS (SELECT n - 1 AS i, pool FROM n UNION ALL SELECT r.i - 1, list_transform(pool, lambda x, p: CASE WHEN p = r.i + 1 THEN pool[j.j + 1] WHEN p = j.j + 1 THEN pool[r.i + 1] ELSE x END) FROM r JOIN j ON j.i = r.i)
SELECT unnest(pool[1:100]) AS p_partkey, unnest(range(0, least(100, len(pool)))) AS place FROM r WHERE i = 0""",
    "hash_seeds": f"SELECT p_partkey, {_fnv('''p_name || '|' || p_brand''')} AS seed FROM part",
    "spread_order": "SELECT s_suppkey, list_sum(list_transform(range(0, 32), lambda i: ((s_suppkey >> i) & 1) * power(2.0, -(i + 1)))) AS place FROM supplier",
    "jittered_moments": f"""WITH src AS (SELECT p_partkey, p_size * 60 AS length, {_fnv("p_partkey || ':6'")} AS seed, m FROM part, (SELECT unnest(range(0, 6)) AS m)), {_draw('seed', 'm + 1')}
SELECT p_partkey, CAST(m AS INTEGER) AS m, CAST(greatest(0, floor(0.05 * length + 0.9::DOUBLE * length / 6 * (m + 0.5) + (draw - 0.5) * 0.8 * (0.9::DOUBLE * length / 6) + 0.5)) AS BIGINT) AS "at" FROM d""",
    "timing_map": f"""WITH {_E} SELECT event_id, array_to_string(list_filter([CASE WHEN k >= 10 THEN 'embed' END, CASE WHEN value / 2 >= 10 THEN 'find' END, CASE WHEN value >= 10 THEN 'load' END], lambda x: x IS NOT NULL), ',') AS steps,
CASE WHEN value / 2 >= 10 THEN value / 2 END AS find, (k >= 10)::INT + (value / 2 >= 10)::INT + (value >= 10)::INT AS n FROM e""",
}
