"""Queries on stores: snapshots, replacement, deltas, resume, migration, JSON lines, vector files, index guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.operators import index as I  # noqa: E741
from entrack.operators import sequences as Q
from entrack.operators import vectors as V
from entrack.sources import files as S
from entrack.sources.tables import table


def snapshot_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot in three part files, read as one; its order is a column."""
    root = S.new_folder(spark, "snapshot")
    p = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 3).alias("part"))
    for i in range(3):
        p.where(F.col("part") == i).write.parquet(f"{root}/part-{i}")
    read = spark.read.parquet(*[f"{root}/part-{i}" for i in range(3)])
    return Q.places(read, ["part"], "p_partkey").select("p_partkey", (F.col("_n") + 1).cast("int").alias("place"), "part")


def store_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded once, replaced whole by a newer version, not by an equal one."""
    store = S.Store(spark, S.new_folder(spark, "store"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    store.seed(c.where("c_nationkey < 5"), "v1")
    store.seed(c, "v1")
    store.replace(c.where("c_nationkey >= 5"), "v2")
    store.replace(c.where("c_nationkey = 0"), "v2")
    return store.read().select("c_custkey")


def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by a list of ids: missing ids are dropped, repeated ones answered as often."""
    ids = table(spark, sf, "supplier").select(F.posexplode(F.array(F.col("s_suppkey") * 7, F.col("s_suppkey"))).alias("at", "id"))
    return ids.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id").groupBy("id", "p_size").agg(F.count("*").alias("asked"))


def _delta(spark: SparkSession, sf: str) -> str:
    root = S.new_folder(spark, "delta")
    e = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("m"), F.col("label") % 3).alias("model_id"))
    e.write.partitionBy("model_id").parquet(root)
    return root


def delta_scan(spark: SparkSession, sf: str) -> DataFrame:
    return S.keep_partitions(spark, _delta(spark, sf), "model_id", ["m1"]).select("vec_id")


def delta_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Other models go with their folders; one model's rows are replaced alone."""
    root = _delta(spark, sf)
    half = table(spark, sf, "embeddings").where("label % 3 = 2 and vec_id % 2 = 0").select("vec_id", F.lit("m2").alias("model_id"))
    S.replace_partitions(half, root, "model_id")
    return S.keep_partitions(spark, root, "model_id", ["m1", "m2"]).groupBy("model_id").agg(F.count("*").alias("n"))


def vector_files(spark: SparkSession, sf: str) -> DataFrame:
    """Quantised vectors written as files of one label each and read back."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("part"), "vec_id", V.quantised(V.normalised(V.doubles(F.col("embedding")))).alias("vec"))
    root = S.new_folder(spark, "vectors")
    S.encoded(e, "part", "vec_id").write.parquet(root)
    dim = 64 if e.isEmpty() else len(e.first()["vec"])
    read = S.decoded(spark.read.parquet(root), "part", dim)
    return read.where("fault is null").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.aggregate("vec", F.lit(0), lambda s, x: s + x)).alias("total"), F.max("pos").alias("last"))


_EVENT = "event_id long, user_id long, event_type string"


def torn_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines whose last line was cut by a crash."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    root = S.new_folder(spark, "lines")
    e.select(F.to_json(F.struct("*")).alias("value")).write.text(root)
    spark.createDataFrame([('{"event_id": 1, "user_i',)], "value string").write.mode("append").text(root)
    return S.read_lines(spark, root, _EVENT)


_ORDER = "o_custkey long, o_orderkey long"


def resumed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A run that stopped and went on: keys already written are skipped, of repeated keys the first counts."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    root = S.new_folder(spark, "resume")
    done = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    done.where("o_custkey % 2 = 0").write.json(root)
    S.append_missing(o.select("o_custkey", "o_orderkey"), root, "o_custkey", _ORDER, ["o_orderkey"])
    S.append_missing(o.select("o_custkey", "o_orderkey"), root, "o_custkey", _ORDER, ["o_orderkey"])
    return S.read_lines(spark, root, _ORDER)


def json_export(spark: SparkSession, sf: str) -> DataFrame:
    root = S.new_folder(spark, "export")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    c.write.json(root)
    return spark.read.text(root).withColumnRenamed("value", "line")


def legacy_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows move where the new store has none; child rows only follow parents that moved."""
    o = table(spark, sf, "orders")
    fresh, old = o.where("o_custkey % 2 = 0").select("o_orderkey"), o.where("o_orderkey % 3 = 0").select("o_orderkey")
    moved = old.join(fresh, "o_orderkey", "left_anti")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return moved.join(lines.join(moved, "o_orderkey", "left_semi"), "o_orderkey", "left").select("o_orderkey", "l_linenumber")


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A store through nine versions and the tenth; older ones and a write that was never committed change nothing."""
    store = S.Store(spark, S.new_folder(spark, "store"))
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    store.seed(p.where("p_size <= 10"), "v2")
    store.replace(p.where("p_size <= 20"), "v9")
    store.replace(p.where("p_size > 20"), "v10")
    store.replace(p.where("p_size <= 5"), "v9")
    store.write(p.where("p_size = 1"))  # broke off before its commit
    return store.read().select("p_partkey", F.lit(store.version()).alias("version"))


def store_migrated(spark: SparkSession, sf: str) -> DataFrame:
    """Both stores after a migration: moved rows are in the new one once, and gone from the old one."""
    old, new = (S.Store(spark, S.new_folder(spark, name)) for name in ("old", "new"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    old.seed(o.where("o_orderkey % 2 = 0"), "1")
    new.seed(o.where("o_custkey % 5 = 0"), "1.2")
    S.migrate(old, new, "o_orderkey", F.col("o_custkey") % 3 == 0)
    return new.read().select("o_orderkey", F.lit("new").alias("store")).unionByName(old.read().select("o_orderkey", F.lit("old").alias("store")))


def store_prefix_deleted(spark: SparkSession, sf: str) -> DataFrame:
    store = S.Store(spark, S.new_folder(spark, "store"))
    store.seed(table(spark, sf, "customer").select("c_custkey", "c_name"), "1")
    store.delete_prefix("c_name", "Customer#00000001")
    return store.read()


def key_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(S.key_range(F.col("c_name"), "Customer#00000001")).select("c_custkey", "c_name")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Base rows and extras, each numbered from 0 after its own filter."""
    p = table(spark, sf, "part").where("p_partkey > 0")

    def numbered(rows: DataFrame) -> DataFrame:
        return Q.places(rows.withColumn("all", F.lit(0)), ["all"], "p_partkey").select(F.col("_n").cast("long").alias("pos"), "item_id")

    base = p.where("p_size % 2 = 0").select("p_partkey", F.col("p_partkey").alias("item_id"))
    extras = p.where("p_size % 2 = 1 and p_size % 3 = 0").select("p_partkey", (-(F.col("p_partkey") * 100 + F.col("p_size"))).alias("item_id"))
    return numbered(base), numbered(extras)


def index_append(spark: SparkSession, sf: str) -> DataFrame:
    base, extras = _parts(spark, sf)
    return I.appended(base, extras).groupBy("origin").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.min("item_id").alias("least"))


def index_strip(spark: SparkSession, sf: str) -> DataFrame:
    base, extras = _parts(spark, sf)
    return I.stripped(I.appended(base, extras).select("pos", "item_id"))


def index_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a second run adds the same rows at the same places, one with its last row less, and one with its rows moved."""
    _, extras = _parts(spark, sf)
    last = extras.agg(F.max("pos")).first()[0]
    runs = {"again": extras, "less": extras.where(F.col("pos") < F.lit(last)), "moved": extras.withColumn("pos", F.lit(last) - F.col("pos"))}
    found = [I.unchanged(extras, after, ["item_id"]).select(F.lit(run).alias("run"), "same") for run, after in runs.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def index_scope(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("entity_id"), "l_quantity", "l_returnflag")  # noqa: E741
    return I.out_of_scope(l.where("l_quantity > 49").select("item_id", "entity_id").distinct(), l.where("l_quantity < 10"), l.where("l_returnflag = 'R' and l_quantity = 25"))


def index_faults(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    dims = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    model = F.when(F.col("vec_id") % 11 == 0, "old").otherwise("new")
    return I.incompatible(e.select("vec_id", dims.alias("vec")), "vec", 64, model, "new")


def gap_decisions(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    own = l.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.count("*").alias("n"))
    outer = l.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_partkey") % 120).alias("variant"), (F.col("l_linenumber") < 5).alias("main"), (F.col("l_quantity") > 10).alias("render"))
    return I.gap_decisions(own, outer, False).groupBy("entity_id", "decision").agg(F.count("*").alias("n"))


def item_listing(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return I.first_listing(table(spark, sf, "supplier").select(key.alias("pos"), key.alias("entity_id"), F.array(key % 17, key * 2, key).alias("item_ids")))


CLEARLY, CLOSEST = 0.45, 0.35


def cosine_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Single-linkage groups by cosine, inside a label."""
    got = V.similar_groups(table(spark, sf, "embeddings"), "vec_id", "embedding", CLOSEST, within="label")
    return got.groupBy("group_id").agg(F.count("*").alias("n"), F.max("node").alias("largest")).where("n > 1")


def unaccepted_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as groups of suppliers, nations as accepted lists."""
    groups = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").alias("entity_id"))
    lists = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("list_id"), F.col("s_suppkey").alias("entity_id"))
    return I.unaccepted(groups, lists)


def decision_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """New items of each label: covered by an own one, like the placeholder, a duplicate of an earlier new one, shared with another label, a look-alike, or added."""
    e = table(spark, sf, "embeddings")
    new = e.select(F.col("vec_id").alias("item"), F.col("label").alias("entity_id"), (F.get("embedding", 0).cast("double") >= 0.2).alias("blank")).where("item % 2 = 1")
    vectors = e.select(F.col("vec_id").alias("node"), F.col("label").alias("entity_id"), F.col("embedding").alias("vec"))
    return I.cascade(new, vectors, F.col("node") % 2 == 0, CLOSEST, CLEARLY).select("item", "entity_id", "decision")


_ALL = (
    snapshot_parts, store_replaced, multi_get, delta_scan, delta_cleared, vector_files, torn_lines, resumed_lines, json_export, legacy_migration, key_prefix, store_versions, store_migrated, store_prefix_deleted,
    index_append, index_strip, index_stable, index_scope, index_faults, gap_decisions, item_listing, cosine_groups, unaccepted_groups, decision_cascade,
)
QUERIES = {f.__name__: f for f in _ALL}

_NORM = "CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0 END"
_COS = """v AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0 END) AS q FROM v),
pr AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 6) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)"""
_PARTS = """b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey AS item_id FROM part WHERE p_partkey > 0 AND p_size % 2 = 0),
x AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, -(p_partkey * 100 + p_size) AS item_id FROM part WHERE p_partkey > 0 AND p_size % 2 = 1 AND p_size % 3 = 0)"""
ORACLES = {
    "snapshot_parts": "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS INTEGER) AS place, p_partkey % 3 AS part FROM part",
    "store_replaced": "SELECT c_custkey FROM customer WHERE c_nationkey >= 5",
    "multi_get": "SELECT id, p_size, count(*) AS asked FROM (SELECT s_suppkey * 7 AS id FROM supplier UNION ALL SELECT s_suppkey FROM supplier) JOIN part ON p_partkey = id GROUP BY ALL",
    "delta_scan": "SELECT vec_id FROM embeddings WHERE label % 3 = 1",
    "delta_cleared": "SELECT 'm' || (label % 3) AS model_id, count(*) AS n FROM embeddings WHERE label % 3 = 1 OR (label % 3 = 2 AND vec_id % 2 = 0) GROUP BY 1",
    "vector_files": f"""WITH v AS (SELECT label::BIGINT AS part, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
q AS (SELECT part, list_sum(list_transform(embedding, lambda x: CAST(floor(greatest(-1.0, least(1.0, {_NORM})) * 127 + 0.5) AS BIGINT))) AS t FROM v) SELECT part, count(*) AS n, CAST(sum(t) AS BIGINT) AS total, count(*) - 1 AS last FROM q GROUP BY 1""",
    "torn_lines": "SELECT event_id, user_id, event_type FROM events",
    "resumed_lines": "SELECT o_custkey, coalesce(CASE WHEN o_custkey % 2 = 0 THEN min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') END, min(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
    "json_export": "SELECT '{\"id\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS line FROM customer",
    "legacy_migration": "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND o_custkey % 2 <> 0",
    "store_versions": "SELECT p_partkey, 'v10' AS version FROM part WHERE p_size > 20",
    "store_migrated": """SELECT o_orderkey, 'new' AS store FROM orders WHERE o_custkey % 5 = 0 OR (o_orderkey % 2 = 0 AND o_custkey % 3 = 0)
UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 <> 0""",
    "store_prefix_deleted": "SELECT c_custkey, c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#00000001')",
    "key_prefix": "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')",
    "index_append": f"WITH {_PARTS} SELECT 'base' AS origin, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, min(item_id) AS least FROM b UNION ALL SELECT 'extra', count(*), CAST(sum(pos + (SELECT max(pos) + 1 FROM b)) AS BIGINT), min(item_id) FROM x",
    "index_strip": f"WITH {_PARTS} SELECT pos, item_id FROM b",
    "index_stable": f"""WITH {_PARTS}, m AS (SELECT max(pos) AS last FROM x),
runs AS (SELECT 'again' AS run, pos, item_id FROM x UNION ALL SELECT 'less', pos, item_id FROM x, m WHERE pos < last UNION ALL SELECT 'moved', last - pos, item_id FROM x, m),
names AS (SELECT unnest(['again', 'less', 'moved']) AS run), wanted AS (SELECT run, pos, item_id FROM names, x)
SELECT n.run, NOT EXISTS (SELECT run, pos, item_id FROM wanted w WHERE w.run = n.run EXCEPT SELECT run, pos, item_id FROM runs r WHERE r.run = n.run)
  AND NOT EXISTS (SELECT run, pos, item_id FROM runs r WHERE r.run = n.run EXCEPT SELECT run, pos, item_id FROM wanted w WHERE w.run = n.run) AS same FROM names n""",
    "index_scope": """SELECT DISTINCT l_partkey AS item_id, l_suppkey AS entity_id FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)
AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 25)""",
    "index_faults": "SELECT CASE WHEN vec_id % 11 = 0 THEN 'other model' ELSE 'other dimension' END AS fault, count(*) AS n FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 = 0 GROUP BY 1",
    "gap_decisions": """WITH o AS (SELECT l_suppkey AS entity_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
x AS (SELECT l_suppkey AS entity_id, l_linenumber < 5 AS main, l_quantity > 10 AS render FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 120 BETWEEN 1 AND 99),
g AS (SELECT entity_id FROM o JOIN (SELECT entity_id, count(*) AS m FROM x GROUP BY 1) USING (entity_id) WHERE m > n)
SELECT entity_id, CASE WHEN NOT main THEN 'out of scope' WHEN NOT render THEN 'no clean render' ELSE 'planned' END AS decision, count(*) AS n FROM x WHERE entity_id IN (SELECT entity_id FROM g) GROUP BY ALL""",
    "item_listing": "WITH i AS (SELECT s_suppkey AS e, unnest([s_suppkey % 17, s_suppkey * 2, s_suppkey]) AS item_id FROM supplier) SELECT item_id, min(e) AS entity_id FROM i GROUP BY 1",
    "cosine_groups": f"""WITH RECURSIVE {_COS}, l AS (SELECT a, b FROM pr WHERE score >= {CLOSEST} UNION ALL SELECT b, a FROM pr WHERE score >= {CLOSEST}),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a), g AS (SELECT node, min(other) AS group_id FROM r GROUP BY node)
SELECT group_id, count(*) AS n, max(node) AS largest FROM g GROUP BY 1 HAVING count(*) > 1""",
    "unaccepted_groups": """WITH m AS (SELECT DISTINCT l_orderkey AS group_id, l_suppkey AS entity_id FROM lineitem)
SELECT group_id, count(*) AS n FROM m LEFT JOIN supplier ON s_suppkey = entity_id GROUP BY 1 HAVING count(*) > 1 AND NOT (count(DISTINCT s_nationkey) = 1 AND count(s_nationkey) = count(*))""",
}
