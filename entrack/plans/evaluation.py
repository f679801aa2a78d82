"""Evaluation queries on embeddings' rankings, labels, events and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.operators import evaluation as E
from entrack.plans.sequences import events
from entrack.sources.tables import table


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored answers: the value and the value before, right unless an error."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf)
    s1 = F.round(F.least(F.lit(1.0), F.col("value") / 100), 4)
    return e.select("event_id", s1.alias("s1"), F.round(s1 * F.coalesce(F.lag("k").over(w), F.lit(0)) / 100, 4).alias("s2"), (F.col("event_type") != "error").alias("correct"), "event_type", "user_id", "k")


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    p = F.percentile("value", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.9)))
    between = e.groupBy("event_type").agg(F.round(p[0], 6).alias("p02"), F.round(p[1], 6).alias("median"), F.round(p[2], 6).alias("p90"))
    places = {"rank_p90": E.nearest_rank(0.9), "upper_median": E.upper_median(), "lower_median": E.lower_median()}
    return between.join(E.ranked_values(e, ["event_type"], "value", places), "event_type")


def eval_buckets(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("s1") > F.col("s2")).alias("top1"), F.count_if(F.col("s1") >= 0.5).alias("confident"),
        F.count_if((F.col("s1") >= 0.5) & ~F.col("correct")).alias("confident_wrong"), F.round(F.percentile("s1", F.lit(0.5)), 6).alias("median"),
    )


def eval_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """One row for all labels, one for each tag and one for each language."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    l = table(spark, sf, "labels").join(d, "doc_id", "left")  # noqa: E741
    groups = F.filter(
        F.array(F.lit("all"), F.concat(F.lit("lang:"), "lang"), F.when(F.col("quality") == 1, F.lit("tag:good")), F.when(F.col("toxic") == 1, F.lit("tag:toxic"))), lambda g: g.isNotNull()
    )
    return E.by_tags(l, groups, [F.count("*").alias("n"), F.sum("toxic").cast("long").alias("toxic"), F.count_distinct("source").alias("sources")])


def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    g = events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.groupBy("event_type").agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def threshold_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return E.outcome(scored(spark, sf), F.lit(0.5), F.lit(0.02), F.lit(0.1), ["event_type"])


def calibrate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibrated(scored(spark, sf), 0.8, 30, 0.0025, 0.3, 0.02)


def calibrate_unreached(spark: SparkSession, sf: str) -> DataFrame:
    """A target that no cut reaches."""
    return E.calibrated(scored(spark, sf).withColumn("correct", F.col("correct") & (F.col("k") % 2 == 0)), 0.99, 60, 0.0025, 0.3, 0.02)


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Accept rules of a grid over five thresholds with at least 100 answers and at most a quarter of them wrong.

    An answer is sure with score and margin or with the second gate's pair, above the floor. Rows are counted by
    the scores' steps first; every rule then works on counts.
    """
    tens = lambda c: F.floor(c * 20 + 1e-9).cast("int")
    s = scored(spark, sf).withColumn("lead", F.round(F.col("s1") - F.col("s2"), 9)).groupBy(tens(F.col("s1")).alias("a"), tens(F.col("lead")).alias("m")).agg(F.count("*").alias("c"), F.count_if(~F.col("correct")).alias("w"))
    rule = spark.range(1).select(F.lit(1).alias("one"))
    for name, values in (("score", (8, 12, 16)), ("margin", (0, 2)), ("floor", (2, 4)), ("score2", (6, 10)), ("margin2", (4, 8))):
        rule = rule.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    sure = F.expr("a >= floor and ((a >= score and m >= margin) or (a >= score2 and m >= margin2))")
    counts = s.join(F.broadcast(rule)).where(sure).groupBy("score", "margin", "floor", "score2", "margin2").agg(F.sum("c").alias("confident"), F.sum("w").alias("wrong"))  # 48 rules
    return counts.where("confident >= 100 and 4 * wrong <= confident")


#: The grid of accept rules: floor, score, margin, and the second gate's pairs, one of which is none.
GRID = {"floor": (0.3, 0.4, 0.5, 0.6), "score": (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9), "margin": (0.01, 0.05, 0.1)}
SECOND = (None, *((s, m) for s in (0.4, 0.5, 0.6, 0.7) for m in (0.12, 0.15, 0.2)))


def grid_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events as readings of two lists, replayed under every rule of the grid: none wrong, one in 25 negatives at most."""
    k, s1 = F.col("k"), F.col("s1")
    a2 = F.round(F.least(F.lit(1.0), s1 * 0.8 + (k % 17) / 50), 4)
    truth = F.when(k % 10 > 0, k % 4)
    rows = scored(spark, sf).select(
        s1.alias("a1"), F.round(s1 - F.col("s2"), 4).alias("m1"), F.when((s1 >= 0.55) | (k % 3 > 0), k % 4).otherwise((k + 1) % 4).alias("top1"),
        a2.alias("a2"), F.round((k % 23) / 100, 4).alias("m2"), F.when((a2 >= 0.45) | (k % 5 > 0), k % 4).otherwise((k + 2) % 4).alias("top2"), truth.alias("truth"), (~F.col("correct")).alias("never"),
    )
    rules = spark.range(1).drop("id")
    for name, values in GRID.items():
        rules = rules.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    seconds = [F.struct(F.lit(p[0] if p else None).cast("double").alias("score2"), F.lit(p[1] if p else None).cast("double").alias("margin2")) for p in SECOND]
    rules = rules.where("score >= floor").select("*", F.inline(F.array(*seconds)))
    return E.grid_replay(rows, rules, rows.count() // 25).select("floor", "score", "margin", "score2", "margin2", "confident", "negative", "place")


def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    before = s.select("event_id", F.when(F.col("s1") >= 0.5, "sure").otherwise("low").alias("state"))
    after = s.select("event_id", F.when(F.col("s2") >= 0.3, "sure").otherwise("low").alias("state"))
    return E.transitions(before, after, ["event_id"])


def report_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose line total and stored total differ by more than the tolerance, by how much."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("total"), 2).alias("difference")).where(F.abs("difference") > 0.005)


def filter_cascade(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rules = [("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 8000), ("table", F.col("text").contains(" | ")), ("foreign", F.col("lang") != "en")]
    return E.rejections(d, rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def group_weights(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("weight", E.capped_weight(["user_id", "event_type"], 3.0))
    return e.groupBy("event_type").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count_distinct("user_id").alias("users"))


def group_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """How far each user's median lies from the median of the type's users, as a ramp from 5 to 50."""
    u = events(spark, sf).groupBy("event_type", "user_id").agg(F.percentile("value", F.lit(0.5)).alias("own"))
    base = u.groupBy("event_type").agg(F.percentile("own", F.lit(0.5)).alias("base"))
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs(F.col("own") - F.col("base")) - 5) / 45))
    return u.join(base, "event_type").select("event_type", "user_id", F.round(ramp, 6).alias("deviation"))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")  # noqa: E741
    return l.groupBy("quality").pivot("toxic", [0, 1]).agg(F.count("doc_id")).select("quality", F.coalesce(F.col("0"), F.lit(0)).alias("clean"), F.coalesce(F.col("1"), F.lit(0)).alias("toxic"))


def conservative_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """A user is good only with a good sign and no bad one."""
    e = events(spark, sf)
    g = e.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 100)).alias("bad"), F.bool_or(F.col("event_type") == "purchase").alias("good"))
    return g.select("user_id", F.when(F.col("bad"), "bad").when(F.col("good"), "good").otherwise("open").alias("verdict"))


def held_out_split(spark: SparkSession, sf: str) -> DataFrame:
    """Everything from the cut date on, and a hashed sixteenth of the rest."""
    o = table(spark, sf, "orders")
    held = (F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")) | (F.md5(F.col("o_orderkey").cast("string").cast("binary")).startswith("0"))
    part = F.when(held, "held").otherwise("train")
    return o.groupBy(part.alias("part"), "o_orderstatus").agg(F.count("*").alias("n"))


def value_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("event_type").agg(F.round(F.corr("value", "k"), 6).alias("r"), F.round(F.avg("k"), 6).alias("mean_k"))


def model_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of the eligible groups the one with the best second score, then the best first."""
    g = scored(spark, sf).groupBy("event_type").agg(F.count_if(F.col("s1") >= 0.2).alias("top5"), F.count_if(F.col("s1") >= 0.5).alias("top1"), F.count("*").alias("n"))
    return g.where("n >= 100").orderBy(F.col("top5").desc(), F.col("top1").desc(), "event_type").limit(1)


_S = """e AS (SELECT event_id, user_id, event_type, round(value, 6) AS value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s AS (SELECT event_id, user_id, event_type, k, round(least(1.0, value / 100), 4) AS s1,
  round(round(least(1.0, value / 100), 4) * coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY event_id), 0) / 100, 4) AS s2, event_type <> 'error' AS correct FROM e)"""
def _calibration(rows: str, precision: float, least: int) -> str:
    return f"""WITH {_S}, q AS (SELECT * FROM {rows}), f AS (SELECT coalesce(floor(quantile_cont(s1, 0.02) * 1000 + 1e-9) / 1000, 0) AS floor FROM q WHERE correct),
p AS (SELECT s1, correct, round(g * 0.0025, 4) AS margin FROM q, f, (SELECT unnest(range(0, 121)) AS g) WHERE s1 >= floor AND round(s1 - s2, 9) >= round(g * 0.0025, 4)),
c AS (SELECT margin, s1, count(*) AS c, count(*) FILTER (WHERE correct) AS r FROM p GROUP BY ALL),
a AS (SELECT margin, s1, sum(c) OVER w AS n, sum(r) OVER w AS r FROM c WINDOW w AS (PARTITION BY margin ORDER BY s1 DESC)),
g AS (SELECT margin, arg_max(s1, n) AS s1, max(n) AS n FROM a WHERE n >= {least} AND r >= {precision} * n GROUP BY margin),
b AS (SELECT coalesce(greatest(max(floor), (SELECT ceil(s1 * 10000 - 1e-9) / 10000 FROM g ORDER BY n DESC, margin LIMIT 1)), 1) AS score, coalesce((SELECT margin FROM g ORDER BY n DESC, margin LIMIT 1), 1) AS margin, max(floor) AS floor, (SELECT count(*) FROM g) > 0 AS found FROM f),
b2 AS (SELECT CASE WHEN found THEN score ELSE 1 END AS score, margin, floor, found FROM b),
j AS (SELECT b2.*, count(*) AS n, count(*) FILTER (WHERE found AND s1 >= floor AND s1 >= score AND round(s1 - s2, 9) >= margin) AS c, count(*) FILTER (WHERE found AND s1 >= floor AND s1 >= score AND round(s1 - s2, 9) >= margin AND correct) AS r FROM q, b2 GROUP BY ALL)
SELECT score, margin, floor, c >= {least} AND r >= {precision} * c AS achieved, round(CASE WHEN c > 0 THEN r / c ELSE 0 END, 9) AS precision, round(c / n, 9) AS coverage FROM j"""


_ALL = (
    percentiles, eval_buckets, eval_by_tag, weighted_mean, threshold_outcome, calibrate_thresholds, calibrate_unreached, threshold_grid, grid_replay, state_transitions, report_differences, filter_cascade,
    group_weights, group_deviation, confusion, conservative_verdict, value_correlation, model_choice, held_out_split,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "percentiles": f"""WITH {_S}, o AS (SELECT event_type, list_sort(list(value)) AS v FROM e GROUP BY 1)
SELECT event_type, round(p02, 6) AS p02, round(median, 6) AS median, round(p90, 6) AS p90, v[CAST(floor(0.9 * (len(v) - 1) + 0.5) AS INT) + 1] AS rank_p90, v[len(v) // 2 + 1] AS upper_median, v[(len(v) - 1) // 2 + 1] AS lower_median
FROM o JOIN (SELECT event_type, quantile_cont(value, 0.02) AS p02, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90 FROM e GROUP BY 1) USING (event_type)""",
    "eval_buckets": f"WITH {_S} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE s1 > s2) AS top1, count(*) FILTER (WHERE s1 >= 0.5) AS confident, count(*) FILTER (WHERE s1 >= 0.5 AND NOT correct) AS confident_wrong, round(quantile_cont(s1, 0.5), 6) AS median FROM s GROUP BY 1",
    "eval_by_tag": """WITH l AS (SELECT l.*, d.lang, d.source FROM labels l LEFT JOIN documents d USING (doc_id)),
g AS (SELECT 'all' AS "group", * FROM l UNION ALL SELECT 'lang:' || lang, * FROM l WHERE lang IS NOT NULL UNION ALL SELECT 'tag:good', * FROM l WHERE quality = 1 UNION ALL SELECT 'tag:toxic', * FROM l WHERE toxic = 1)
SELECT "group", count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic, count(DISTINCT source) AS sources FROM g GROUP BY 1""",
    "weighted_mean": f"WITH {_S}, g AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS mean FROM e GROUP BY ALL) SELECT event_type, round(sum(mean * n) / sum(n), 6) AS mean FROM g GROUP BY 1",
    "threshold_outcome": f"""WITH {_S}, c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE s1 >= 0.1 AND s1 >= 0.5 AND round(s1 - s2, 9) >= 0.02) AS confident,
  count(*) FILTER (WHERE s1 >= 0.1 AND s1 >= 0.5 AND round(s1 - s2, 9) >= 0.02 AND correct) AS r, count(*) FILTER (WHERE s1 < 0.1) AS below FROM s GROUP BY 1)
SELECT event_type, confident, round(CASE WHEN confident > 0 THEN r / confident ELSE 0 END, 9) AS precision, round(confident / n, 9) AS coverage, round(below / n, 9) AS nothing FROM c""",
    "calibrate_thresholds": _calibration("s", 0.8, 30),
    "calibrate_unreached": _calibration("(SELECT event_id, user_id, event_type, k, s1, s2, correct AND k % 2 = 0 AS correct FROM s)", 0.99, 60),
    "threshold_grid": f"""WITH {_S} SELECT score, margin, floor, score2, margin2, count(*) AS confident, count(*) FILTER (WHERE NOT correct) AS wrong FROM s,
(SELECT unnest([8, 12, 16]) AS score), (SELECT unnest([0, 2]) AS margin), (SELECT unnest([2, 4]) AS floor), (SELECT unnest([6, 10]) AS score2), (SELECT unnest([4, 8]) AS margin2)
WHERE round(s1 * 20, 6) >= floor AND ((round(s1 * 20, 6) >= score AND round((s1 - s2) * 20, 6) >= margin) OR (round(s1 * 20, 6) >= score2 AND round((s1 - s2) * 20, 6) >= margin2))
GROUP BY ALL HAVING count(*) >= 100 AND 4 * count(*) FILTER (WHERE NOT correct) <= count(*)""",
    "grid_replay": f"""WITH {_S}, r AS (SELECT s1 AS a1, round(s1 - s2, 4) AS m1, CASE WHEN s1 >= 0.55 OR k % 3 > 0 THEN k % 4 ELSE (k + 1) % 4 END AS top1,
  round(least(1.0, s1 * 0.8::DOUBLE + (k % 17) / 50), 4) AS a2, round((k % 23) / 100, 4) AS m2, k, CASE WHEN k % 10 > 0 THEN k % 4 END AS truth, NOT correct AS never FROM s),
q AS (SELECT *, CASE WHEN a2 >= 0.45 OR k % 5 > 0 THEN k % 4 ELSE (k + 2) % 4 END AS top2 FROM r),
g AS (SELECT * FROM (SELECT unnest({list(GRID["floor"])}::DOUBLE[]) AS floor), (SELECT unnest({list(GRID["score"])}::DOUBLE[]) AS score), (SELECT unnest({list(GRID["margin"])}::DOUBLE[]) AS margin),
  (VALUES {", ".join("(NULL::DOUBLE, NULL::DOUBLE)" if p is None else f"({p[0]}::DOUBLE, {p[1]}::DOUBLE)" for p in SECOND)}) t(score2, margin2) WHERE score >= floor),
d AS (SELECT g.*, q.*, a1 >= floor AND ((a1 >= score AND m1 >= margin) OR coalesce(a1 >= score2 AND m1 >= margin2, false)) AS one,
  a2 >= floor AND ((a2 >= score AND m2 >= margin) OR coalesce(a2 >= score2 AND m2 >= margin2, false)) AS two FROM g, q WHERE NOT never),
o AS (SELECT floor, score, margin, score2, margin2, truth, CASE WHEN one THEN top1 ELSE top2 END AS top, one OR two AS sure FROM d),
t AS (SELECT floor, score, margin, score2, margin2, count(*) FILTER (WHERE sure AND truth = top) AS confident, count(*) FILTER (WHERE sure AND truth <> top) AS wrong, count(*) FILTER (WHERE sure AND truth IS NULL) AS negative FROM o GROUP BY ALL)
SELECT floor, score, margin, score2, margin2, confident, negative, CAST(row_number() OVER (ORDER BY confident DESC, negative, score DESC, floor DESC, margin, score2 NULLS FIRST, margin2 NULLS FIRST) AS INTEGER) AS place
FROM t WHERE wrong = 0 AND negative <= (SELECT count(*) FROM q) // 25""",
    "state_transitions": f"WITH {_S} SELECT CASE WHEN s1 >= 0.5 THEN 'sure' ELSE 'low' END AS was, CASE WHEN s2 >= 0.3 THEN 'sure' ELSE 'low' END AS is_now, count(*) AS n FROM s GROUP BY ALL",
    "report_differences": "WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey, round(o_totalprice - total, 2) AS difference FROM orders JOIN t ON l_orderkey = o_orderkey WHERE abs(round(o_totalprice - total, 2)) > 0.005",
    "filter_cascade": "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8000 THEN 'long' WHEN contains(text, ' | ') THEN 'table' WHEN lang <> 'en' THEN 'foreign' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "group_weights": f"WITH {_S}, w AS (SELECT *, least(1.0, 3.0 / count(*) OVER (PARTITION BY user_id, event_type)) AS weight FROM e) SELECT event_type, round(sum(weight), 6) AS weight, count(DISTINCT user_id) AS users FROM w GROUP BY 1",
    "group_deviation": f"""WITH {_S}, u AS (SELECT event_type, user_id, quantile_cont(value, 0.5) AS own FROM e GROUP BY ALL), b AS (SELECT event_type, quantile_cont(own, 0.5) AS base FROM u GROUP BY 1)
SELECT event_type, user_id, round(greatest(0.0, least(1.0, (abs(own - base) - 5) / 45)), 6) AS deviation FROM u JOIN b USING (event_type)""",
    "confusion": "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1",
    "conservative_verdict": f"WITH {_S} SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 100) THEN 'bad' WHEN bool_or(event_type = 'purchase') THEN 'good' ELSE 'open' END AS verdict FROM e GROUP BY 1",
    "value_correlation": f"WITH {_S} SELECT event_type, round(corr(value, k), 6) AS r, round(avg(k), 6) AS mean_k FROM e GROUP BY 1",
    "held_out_split": "SELECT CASE WHEN o_orderdate >= DATE '1998-01-01' OR starts_with(md5(CAST(o_orderkey AS VARCHAR)), '0') THEN 'held' ELSE 'train' END AS part, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "model_choice": f"WITH {_S} SELECT event_type, count(*) FILTER (WHERE s1 >= 0.2) AS top5, count(*) FILTER (WHERE s1 >= 0.5) AS top1, count(*) AS n FROM s GROUP BY 1 HAVING n >= 100 ORDER BY top5 DESC, top1 DESC, event_type LIMIT 1",
}
