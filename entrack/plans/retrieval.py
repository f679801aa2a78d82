"""Queries over the embeddings table: every row divisible by 100 asks all other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.config import SYNTHETIC as T
from entrack.operators import ranking as R
from entrack.operators import vectors as V
from entrack.sources.tables import table

K = 10


def index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pos"), F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("entity_id"), V.doubles(F.col("embedding")).alias("vec")
    )


def asked(idx: DataFrame) -> DataFrame:
    """Two variants of each query: the vector and the vector read backwards."""
    plain = idx.where("item_id % 100 = 0")
    return plain.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), "vec").unionByName(
        plain.select(F.col("item_id").alias("query_id"), F.lit(1).alias("variant"), F.reverse("vec").alias("vec"))
    )


def lists(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    idx = index(spark, sf)
    return V.top_entities(V.entity_scores(idx, asked(idx)), k)


def single(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    idx = index(spark, sf)
    return V.top_entities(V.entity_scores(idx, asked(idx).where("variant = 0")), k).drop("variant", "first_pos")


def knn_top_entities(spark: SparkSession, sf: str) -> DataFrame:
    got = R.with_lead(single(spark, sf)).where("rank <= 3")
    v = R.verdict(F.col("score"), F.col("lead"), F.col("entity_id"), T)
    return got.select("query_id", "rank", "entity_id", "item_id", "score", "lead", v.alias("verdict"))


def knn_int8(spark: SparkSession, sf: str) -> DataFrame:
    idx = index(spark, sf).withColumn("vec", V.quantised(F.col("vec")))
    scores = V.entity_scores(idx, asked(idx).where("variant = 0"), scale=1 / (127 * 127))
    return V.top_entities(scores, 5).select("query_id", "rank", "entity_id", "item_id", "score")


def knn_fused_variants(spark: SparkSession, sf: str) -> DataFrame:
    return R.fused(lists(spark, sf), 5).select("query_id", "rank", "entity_id", "item_id", "score", "from_list")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    top = R.with_lead(R.fused(lists(spark, sf), K)).where("rank = 1")
    return top.select("query_id", "entity_id", "score", "lead", R.verdict(F.col("score"), F.col("lead"), F.col("entity_id"), T).alias("verdict"))


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return R.suggestions(R.fused(lists(spark, sf), K), T.floor - 0.05, 0.06, 4).select("query_id", "place", "entity_id", "score")


def staged_cascade(spark: SparkSession, sf: str) -> DataFrame:
    found = lists(spark, sf).withColumn("stage_no", F.col("variant"))
    return R.staged(found, 2, K, T).select("query_id", "stage", "entity_id", "item_id", "score", "lead", "verdict")


def rescue_and_low_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a rescue would be taken (floor and lead, no sentinel), and whether a weak answer is labelled."""
    top = R.with_lead(R.fused(lists(spark, sf), K)).where("rank = 1")
    return top.select(
        "query_id",
        ((F.col("score") >= T.floor) & (F.col("lead") >= 0.03) & (F.col("entity_id") != -1)).alias("rescued"),
        ((F.col("from_list") == 0) & (F.col("lead") < 0.07)).alias("low_match"),
    )


def placeholder_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows unlike the sentinel's vector, here the first row's; the sentinel is one row."""
    idx = index(spark, sf)
    sentinel = idx.where("item_id = 0").limit(1).select(F.col("vec").alias("sentinel"))
    scored = idx.crossJoin(F.broadcast(sentinel)).withColumn("likeness", F.round(V.dot(F.col("vec"), F.col("sentinel")), 6))
    return scored.select("item_id", "entity_id", "likeness", (F.col("likeness") >= 0.35).alias("placeholder"))


def own_vs_other(spark: SparkSession, sf: str) -> DataFrame:
    """The best likeness to the own entity and to any other one."""
    idx = index(spark, sf)
    scores = V.entity_scores(idx, asked(idx).where("variant = 0"))
    truth = idx.select(F.col("item_id").alias("query_id"), F.col("entity_id").alias("truth"))
    joined = scores.join(truth, "query_id")
    return joined.groupBy("query_id").agg(
        F.max(F.when(F.col("entity_id") == F.col("truth"), F.col("score"))).alias("own"),
        F.max(F.when(F.col("entity_id") != F.col("truth"), F.col("score"))).alias("other"),
    )


def normalise_quantise(spark: SparkSession, sf: str) -> DataFrame:
    idx = index(spark, sf)
    q = V.quantised(V.normalised(F.transform("vec", lambda x: x * 3)))
    return idx.select(
        "item_id",
        F.aggregate(q, F.lit(0), lambda s, x: s + x.cast("int")).alias("byte_sum"),
        F.array_max(q).cast("int").alias("byte_max"),
        F.round(F.get(V.pooled(F.col("vec"), 4, "mean"), F.lit(0)), 6).alias("mean_pool_0"),
        F.round(F.get(V.pooled(F.col("vec"), 4, "first"), F.lit(1)), 6).alias("first_pool_1"),
    )


def truth_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the true entity: one more than the entities with a greater score; its list place, -1 when absent."""
    idx = index(spark, sf)
    scores = V.entity_scores(idx, asked(idx).where("variant = 0"))
    truth = idx.select(F.col("item_id").alias("query_id"), F.col("entity_id").alias("truth"))
    places = V.top_entities(scores, K).join(truth, "query_id").groupBy("query_id").agg(F.max(F.when(F.col("entity_id") == F.col("truth"), F.col("rank") - 1)).alias("place"))
    own = scores.join(truth, "query_id").withColumn("own", F.max(F.when(F.col("entity_id") == F.col("truth"), F.col("score"))).over(Window.partitionBy("query_id")))
    ranks = own.groupBy("query_id").agg((F.count_if(F.col("score") > F.col("own")) + 1).alias("truth_rank"))
    return ranks.join(places, "query_id").select("query_id", "truth_rank", F.coalesce("place", F.lit(-1)).alias("place"))


def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    ranks = truth_rank(spark, sf)
    return ranks.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("place") == 0).alias("top1"),
        F.count_if(F.col("place").between(0, 4)).alias("top5"),
        F.round(F.avg((F.col("place").between(0, 4)).cast("double")), 6).alias("recall5"),
    )


_IDX = """idx AS (
  SELECT vec_id AS pos, vec_id AS item_id, CAST(label AS BIGINT) AS entity_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings
), asked AS (
  SELECT item_id AS query_id, 0 AS variant, vec FROM idx WHERE item_id % 100 = 0
  UNION ALL SELECT item_id, 1, list_reverse(vec) FROM idx WHERE item_id % 100 = 0
), sc AS (
  SELECT a.query_id, a.variant, i.entity_id, i.item_id, i.pos, round(list_inner_product(a.vec, i.vec), 6) AS score
  FROM asked a JOIN idx i ON a.query_id <> i.item_id
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant, entity_id ORDER BY score DESC, pos) AS n,
         min(pos) OVER (PARTITION BY query_id, variant, entity_id) AS first_pos FROM sc
), ent AS (SELECT query_id, variant, entity_id, item_id, score, first_pos FROM picked WHERE n = 1
), lists AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, first_pos, entity_id) AS INTEGER) AS rank FROM ent) WHERE rank <= 10
)"""
_LED = """led AS (SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0), 6) AS lead FROM lists WHERE variant = 0)"""


def _fused_sql(source: str = "lists", key: str = "query_id") -> str:
    return f"""fp AS (
  SELECT {key}, entity_id, item_id, score, variant AS from_list,
         row_number() OVER (PARTITION BY {key}, entity_id ORDER BY score DESC, variant, rank) AS n,
         min(variant * 1000 + rank) OVER (PARTITION BY {key}, entity_id) AS first FROM {source}
), fused AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY score DESC, first) AS INTEGER) AS rank FROM fp WHERE n = 1) WHERE rank <= 10
), fl AS (SELECT *, round(score - coalesce(lead(score) OVER (PARTITION BY {key} ORDER BY rank), 0), 6) AS lead FROM fused)"""


_VERDICT = f"""CASE WHEN score < {T.floor} THEN 'none' WHEN ((score >= {T.score} AND lead >= {T.margin}) OR (score >= {T.second_score} AND lead >= {T.second_margin}))
  AND (entity_id <> -1 OR lead >= {T.sentinel_margin}) THEN 'sure' ELSE 'low' END"""

QUERIES = {
    f.__name__: f
    for f in (
        knn_top_entities, knn_int8, knn_fused_variants, verdicts, suggestions, staged_cascade, rescue_and_low_match, placeholder_filter,
        own_vs_other, normalise_quantise, truth_rank, recall_at_k,
    )
}

_TRUTH = f"""WITH {_IDX}, own AS (
  SELECT e.*, i.entity_id AS truth, max(CASE WHEN e.entity_id = i.entity_id THEN score END) OVER (PARTITION BY e.query_id) AS own
  FROM ent e JOIN idx i ON i.item_id = e.query_id WHERE e.variant = 0
), ranks AS (SELECT query_id, count(*) FILTER (WHERE score > own) + 1 AS truth_rank FROM own GROUP BY query_id
), places AS (SELECT l.query_id, max(CASE WHEN l.entity_id = i.entity_id THEN rank - 1 END) AS place FROM lists l JOIN idx i ON i.item_id = l.query_id WHERE variant = 0 GROUP BY ALL
), tr AS (SELECT query_id, truth_rank, coalesce(place, -1) AS place FROM ranks JOIN places USING (query_id))"""

ORACLES = {
    "knn_top_entities": f"WITH {_IDX}, {_LED} SELECT query_id, rank, entity_id, item_id, score, lead, {_VERDICT} AS verdict FROM led WHERE rank <= 3",
    "knn_int8": """WITH idx AS (
  SELECT vec_id AS pos, vec_id AS item_id, CAST(label AS BIGINT) AS entity_id,
         list_transform(embedding, lambda x: floor(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 127 + 0.5)) AS vec FROM embeddings
), sc AS (SELECT a.item_id AS query_id, i.entity_id, i.item_id, i.pos, round(list_inner_product(a.vec, i.vec) * (1.0 / (127 * 127)), 6) AS score FROM idx a JOIN idx i ON a.item_id <> i.item_id WHERE a.item_id % 100 = 0
), picked AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY score DESC, pos) AS n, min(pos) OVER (PARTITION BY query_id, entity_id) AS first_pos FROM sc)
SELECT query_id, rank, entity_id, item_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_pos, entity_id) AS INTEGER) AS rank FROM picked WHERE n = 1) WHERE rank <= 5""",
    "knn_fused_variants": f"WITH {_IDX}, {_fused_sql()} SELECT query_id, rank, entity_id, item_id, score, from_list FROM fused WHERE rank <= 5",
    "verdicts": f"WITH {_IDX}, {_fused_sql()} SELECT query_id, entity_id, score, lead, {_VERDICT} AS verdict FROM fl WHERE rank = 1",
    "suggestions": f"""WITH {_IDX}, {_fused_sql()}, tops AS (SELECT query_id, score AS top, entity_id AS top_entity FROM fused WHERE rank = 1),
kept AS (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY rank) AS place FROM fused f JOIN tops t USING (query_id)
  WHERE top_entity <> -1 AND entity_id <> -1 AND score >= {T.floor - 0.05} AND round(top - score, 6) <= 0.06)
SELECT query_id, CAST(place AS INTEGER) AS place, entity_id, score FROM kept WHERE place <= 4""",
    "staged_cascade": f"""WITH {_IDX}, upto AS (SELECT l.*, s.stage, l.query_id * 10 + s.stage AS qs FROM lists l JOIN (SELECT unnest([0, 1]) AS stage) s ON l.variant <= s.stage),
{_fused_sql("upto", "qs")}, tops AS (SELECT *, qs // 10 AS query_id, CAST(qs % 10 AS INTEGER) AS stage, {_VERDICT} AS verdict FROM fl WHERE rank = 1)
SELECT query_id, stage, entity_id, item_id, score, lead, verdict FROM tops
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN verdict = 'sure' THEN stage ELSE 2 END, stage DESC) = 1""",
    "rescue_and_low_match": f"WITH {_IDX}, {_fused_sql()} SELECT query_id, score >= {T.floor} AND lead >= 0.03 AND entity_id <> -1 AS rescued, from_list = 0 AND lead < 0.07 AS low_match FROM fl WHERE rank = 1",
    "placeholder_filter": f"WITH {_IDX}, l AS (SELECT i.item_id, i.entity_id, round(list_inner_product(i.vec, s.vec), 6) AS likeness FROM idx i, (SELECT vec FROM idx WHERE item_id = 0) s) SELECT *, likeness >= 0.35 AS placeholder FROM l",
    "own_vs_other": f"""WITH {_IDX} SELECT e.query_id, max(CASE WHEN e.entity_id = i.entity_id THEN score END) AS own, max(CASE WHEN e.entity_id <> i.entity_id THEN score END) AS other
FROM ent e JOIN idx i ON i.item_id = e.query_id WHERE variant = 0 GROUP BY e.query_id""",
    "normalise_quantise": f"""WITH {_IDX}, n AS (SELECT item_id, vec, list_transform(vec, lambda x: x * 3) AS v3 FROM idx),
q AS (SELECT item_id, vec, list_transform(v3, lambda x: CAST(floor(greatest(-1.0, least(1.0, x / sqrt(list_inner_product(v3, v3)))) * 127 + 0.5) AS INTEGER)) AS b FROM n)
SELECT item_id, CAST(list_sum(b) AS INTEGER) AS byte_sum, list_max(b) AS byte_max, round((vec[1] + vec[17] + vec[33] + vec[49]) / 4, 6) AS mean_pool_0, round(vec[2], 6) AS first_pool_1 FROM q""",
    "truth_rank": f"{_TRUTH} SELECT query_id, truth_rank, place FROM tr",
    "recall_at_k": f"{_TRUTH} SELECT count(*) AS n, count(*) FILTER (WHERE place = 0) AS top1, count(*) FILTER (WHERE place BETWEEN 0 AND 4) AS top5, round(avg(CASE WHEN place BETWEEN 0 AND 4 THEN 1.0 ELSE 0.0 END), 6) AS recall5 FROM tr",
}
