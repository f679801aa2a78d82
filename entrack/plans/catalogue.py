"""Catalogue queries on part, supplier, customer, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.functions import text as X
from entrack.operators import catalogue as C
from entrack.operators import names as N
from entrack.sources.tables import table

#: The searches of the name queries.
SEARCHES = ("copper", "lime copper", "smal brass", "pr", "steel anodized polished", "  ")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id"), X.name_key(F.col("p_name")).alias("key"))


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed searches, and the names of all parts whose id is divisible by 100 without their last letter."""
    rows = spark.createDataFrame(list(enumerate(SEARCHES)), "query_id long, raw string")
    cut = F.expr("substring(p_name, 1, length(p_name) - 1)")
    rows = rows.unionByName(table(spark, sf, "part").where("p_partkey % 100 = 0").select((F.col("p_partkey") + 1000).alias("query_id"), cut.alias("raw")))
    return rows.select("query_id", X.name_key(F.substring("raw", 1, 60)).alias("query"))


def name_key(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.name_key(F.concat_ws(" & ", "p_name", "p_brand", "p_type")).alias("key"))


def name_match(spark: SparkSession, sf: str) -> DataFrame:
    return N.fuzzy_matches(_searches(spark, sf), _names(spark, sf), 5)


def name_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The best fuzzy answer, accepted from 0.85 on."""
    best = N.fuzzy_matches(_searches(spark, sf), _names(spark, sf), 1)
    return best.select("query_id", "id", "score", (F.col("score") >= 0.85).alias("accepted"))


def name_search_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return N.tiered_search(_searches(spark, sf), _names(spark, sf), 8)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as records of two items each."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("pos"), key.alias("id"), F.col("c_name").alias("name"), F.array(key * 10, key * 10 + 1).alias("item_ids"))


def _enrich(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each customer that names it by id, by an item or by name only, as its nation has it."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    by = F.when(nation < 8, key).when(nation < 16, key * 10 + 1).otherwise(-key)
    return table(spark, sf, "customer").select(key.alias("row_no"), by.alias("id"), F.when(nation < 20, F.col("c_name")).otherwise("?").alias("name"), F.floor("c_acctbal").cast("long").alias("points"))


def enrich_priority_join(spark: SparkSession, sf: str) -> DataFrame:
    merged, _ = C.prioritised_join(_records(spark, sf), _enrich(spark, sf))
    return merged.select("id", "how", "points")


def enrich_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return C.prioritised_join(_records(spark, sf), _enrich(spark, sf))[1].select("row_no", "points")


def localise_overlay(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    texts = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    texts = texts.unionByName(c.where("c_acctbal < 0").select((F.col("c_custkey") * 10 + 1).alias("id"), F.concat(F.lit("item "), "c_name").alias("text")))
    got = C.localised(_records(spark, sf).select("id", "name", "item_ids"), texts)
    return got.select("id", F.coalesce("text", "name").alias("shown"), F.col("text").isNotNull().alias("translated"))


def index_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in neither base (orders' share) nor delta."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    have = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("item_id")).distinct()
    return p.join(have, "item_id", "left_anti")


def index_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_size")
    got = C.merged_index(p.where("p_size <= 30"), p.where("p_size >= 20"), p.where("p_size = 25"), "item_id")
    return got.select("item_id", "origin")


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return C.upserted(e.where("value < 50"), e.where("value >= 50"), ["user_id", "event_type"], "event_id")


def todo_with_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    failures = e.where("event_type = 'error' or value < 10").select(F.col("user_id").alias("item_id"), "at")
    catalogue = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"))
    missing = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    now = F.lit(1704067200.0 + 86400 * 15)
    return C.to_do(missing, catalogue, failures, now, F.lit(86400.0 * 7), "item_id")


def index_difference(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_size")
    return C.difference(p.where("p_size <= 30"), p.where("p_size >= 10"), "item_id")


def items_in_all(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that every one of three indexes has."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), "l_returnflag")  # noqa: E741
    a, b, c = (l.where(F.col("l_returnflag") == f).select("item_id").distinct() for f in "ANR")
    return a.join(b, "item_id", "left_semi").join(c, "item_id", "left_semi")


def first_wins_items(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_wins(table(spark, sf, "conversations"), "conv_id", ["turn", "role"]).select("conv_id", "turn", "role")


def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return C.latest(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def gap_plan(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    own = l.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.count("*").alias("n"))
    other = l.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.count("*").alias("n"))
    return C.gap_plan(own, other).select("entity_id", "missing", "planned")


#: Ids around the sentinel and the first synthetic one.
EDGE_IDS = (-1, -99, -100, -101, -199, -200, -201, 0, 7)


def synthetic_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "part").select("p_partkey", X.synthetic_id(F.col("p_partkey"), F.col("p_size") * 3).alias("item_id"))
    edges = spark.createDataFrame([(-1, i) for i in EDGE_IDS], "p_partkey long, item_id long")
    parts = X.synthetic_parts(F.col("item_id"))
    return made.unionByName(edges).select("p_partkey", "item_id", X.is_synthetic(F.col("item_id")).alias("synthetic"), parts["source_id"].alias("source_id"), parts["variant"].alias("variant"))


def prices_and_points(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", X.positive_price(raw).alias("price"), F.when(F.floor("c_acctbal") > 0, F.floor("c_acctbal")).alias("points"))


_KEY = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_SEARCH = "searches AS (SELECT query_id, " + _KEY.format("substr(raw, 1, 60)") + " AS query FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEARCHES)) + ") t(query_id, raw) UNION ALL SELECT p_partkey + 1000, " + _KEY.format("substr(substr(p_name, 1, length(p_name) - 1), 1, 60)") + " FROM part WHERE p_partkey % 100 = 0)"
_FUZZY = f"""{_SEARCH}, names AS (SELECT p_partkey AS pos, p_partkey AS id, {_KEY.format("p_name")} AS key FROM part),
sim AS (SELECT query_id, id, pos, CASE WHEN query = key THEN 1.0 ELSE round(greatest(0.0, 1.0 - CAST(levenshtein(query, key) AS DOUBLE) / greatest(1, length(query), length(key))), 9) END AS score
  FROM searches JOIN names ON length(query) > 0)"""
_REC = "records AS (SELECT c_custkey AS pos, c_custkey AS id, c_name AS name, [c_custkey * 10, c_custkey * 10 + 1] AS item_ids FROM customer)"
_MATCH = f"""{_REC}, enrich AS (SELECT c_custkey AS row_no, CASE WHEN c_nationkey < 8 THEN c_custkey WHEN c_nationkey < 16 THEN c_custkey * 10 + 1 ELSE -c_custkey END AS id,
  CASE WHEN c_nationkey < 20 THEN c_name ELSE '?' END AS name, CAST(floor(c_acctbal) AS BIGINT) AS points FROM customer),
items AS (SELECT unnest(item_ids) AS item, pos FROM records),
found AS (
  SELECT row_no, points, 0 AS how, max(r.pos) AS record FROM enrich e JOIN records r ON r.id = e.id GROUP BY ALL
  UNION ALL SELECT row_no, points, 1, min(i.pos) FROM enrich e JOIN items i ON i.item = e.id GROUP BY ALL
  UNION ALL SELECT row_no, points, 2, min(r.pos) FROM enrich e JOIN records r ON r.name = e.name GROUP BY ALL
), firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY how, record) = 1),
best AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY record ORDER BY how, points DESC, row_no) = 1)"""

_ALL = (
    name_key, name_match, name_accepted, name_search_tiers, enrich_priority_join, enrich_unmatched, localise_overlay, index_missing, index_merge, index_upsert,
    todo_with_cooldown, index_difference, items_in_all, first_wins_items, last_write_wins, gap_plan, synthetic_ids, prices_and_points,
)
QUERIES = {f.__name__: f for f in _ALL}

_PREFIX = """list_reduce(list_prepend({'ok': true, 'left': string_split(key, ' '), 'q': ''}, list_transform(string_split(query, ' '), lambda q: {'ok': true, 'left': []::VARCHAR[], 'q': q})),
  lambda s, x: {'ok': s.ok AND len(list_filter(s.left, lambda t: starts_with(t, x.q))) > 0,
    'left': CASE WHEN len(list_filter(s.left, lambda t: starts_with(t, x.q))) = 0 THEN s.left ELSE list_filter(s.left, lambda t, i: i <> list_position(list_transform(s.left, lambda u: starts_with(u, x.q)), true)) END, 'q': ''}).ok"""
ORACLES = {
    "name_key": f"SELECT p_partkey, {_KEY.format('concat_ws(chr(32) || chr(38) || chr(32), p_name, p_brand, p_type)')} AS key FROM part",
    "name_match": f"WITH {_FUZZY} SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS rank, id, pos, score FROM sim) WHERE rank <= 5",
    "name_accepted": f"WITH {_FUZZY} SELECT query_id, id, score, score >= 0.85 AS accepted FROM sim QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) = 1",
    "name_search_tiers": f"""WITH {_FUZZY}, pairs AS (SELECT query_id, id, pos, key, CASE WHEN {_PREFIX} THEN 0 WHEN contains(key, query) THEN 1 END AS tier FROM searches JOIN names ON length(query) > 0),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(key), key, pos) AS n FROM pairs WHERE tier IS NOT NULL) WHERE n <= 8),
fz AS (SELECT * FROM (SELECT query_id, id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS n FROM sim) WHERE n <= 8),
every AS (SELECT query_id, id, pos, tier, n, CASE WHEN tier = 0 THEN 1.0 ELSE 0.8 END AS score FROM exact
  UNION ALL SELECT query_id, id, pos, 2, n, score FROM fz WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = fz.query_id AND e.pos = fz.pos))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, n) AS INTEGER) AS rank, id, pos, score FROM every) WHERE rank <= 8""",
    "enrich_priority_join": f"WITH {_MATCH} SELECT r.id, b.how, b.points FROM records r LEFT JOIN best b ON b.record = r.pos",
    "enrich_unmatched": f"WITH {_MATCH} SELECT row_no, points FROM enrich WHERE points > 0 AND row_no NOT IN (SELECT row_no FROM firsts)",
    "localise_overlay": f"""WITH {_REC}, texts AS (SELECT c_custkey AS id, c_name AS text FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey * 10 + 1, 'item ' || c_name FROM customer WHERE c_acctbal < 0),
through AS (SELECT r.id, arg_min(t.text, i) AS text FROM (SELECT id, unnest(item_ids) AS item, generate_subscripts(item_ids, 1) AS i FROM records) r JOIN texts t ON t.id = r.item GROUP BY r.id)
SELECT r.id, coalesce(t.text, h.text, r.name) AS shown, coalesce(t.text, h.text) IS NOT NULL AS translated FROM records r LEFT JOIN texts t ON t.id = r.id LEFT JOIN through h ON h.id = r.id""",
    "index_missing": "SELECT p_partkey AS item_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "index_merge": "SELECT p_partkey AS item_id, CASE WHEN p_size <= 30 THEN 'base' ELSE 'delta' END AS origin FROM part WHERE (p_size <= 30 OR p_size >= 20) AND p_size <> 25",
    "index_upsert": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value >= 50 DESC, event_id DESC) = 1",
    "todo_with_cooldown": """SELECT p_partkey AS item_id FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer) AND p_partkey NOT IN (
  SELECT user_id FROM events WHERE (event_type = 'error' OR value < 10) AND 1704067200.0 + 86400 * 15 - epoch_us(ts) / 1e6 < 86400.0 * 7)""",
    "index_difference": "SELECT p_partkey AS item_id, 'added' AS change FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 'removed' FROM part WHERE p_size < 10",
    "items_in_all": "SELECT l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "first_wins_items": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) = 1",
    "last_write_wins": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "gap_plan": """WITH o AS (SELECT l_suppkey AS entity_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), x AS (SELECT l_suppkey AS entity_id, count(*) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT entity_id, greatest(m - n, 0) AS missing, m > n AS planned FROM o JOIN x USING (entity_id)""",
    "synthetic_ids": f"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey >= 1 AND p_size * 3 <= 99 THEN -(p_partkey * 100 + p_size * 3) END AS item_id FROM part
  UNION ALL SELECT -1, i FROM (VALUES {", ".join(f"({i})" for i in EDGE_IDS)}) t(i)), m AS (SELECT *, item_id < -100 AND (-item_id) % 100 <> 0 AS synthetic FROM s)
SELECT *, CASE WHEN synthetic THEN (-item_id) // 100 END AS source_id, CASE WHEN synthetic THEN (-item_id) % 100 END AS variant FROM m""",
    "prices_and_points": "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_acctbal > 0 THEN c_acctbal END AS price, CASE WHEN floor(c_acctbal) > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS points FROM customer",
}
