"""Queries on events: history, logs, pacing, sessions and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.operators import sequences as S
from entrack.sources.tables import table


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "event_type", F.round("value", 6).alias("value"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6).alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def rescan_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return S.without_rescans(events(spark, sf), "user_id", "event_type", "at", "event_id", 40_000.0).select("event_id", "user_id", "event_type")


def newest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.newest(events(spark, sf), ["user_id"], ["at", "event_id"], 10).select("user_id", "event_id")


def dual_cap(spark: SparkSession, sf: str) -> DataFrame:
    return S.capped(events(spark, sf), ["user_id"], ["at", "event_id"], "k", 15, 500.0).select("user_id", "event_id", "k")


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    got = S.appearances(events(spark, sf), ["user_id", "event_type"], "value", ["event_id"], 20.0)
    return got.select("user_id", "event_type", "first_time", "last_time", "appearances")


def session_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's log: entities newest first, at most three."""
    e = events(spark, sf)
    log = S.appearances(e, ["user_id", "event_type"], "value", ["event_id"], 20.0)
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy(F.col("first_id").desc())
    return log.join(first, ["user_id", "event_type"]).withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", "place", "event_type", "appearances")


def rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    got = S.rate_slots(events(spark, sf), ["user_id"], "at", ["at", "event_id"], 30_000.0)
    return got.select("event_id", F.round("slot", 3).alias("slot"))


def slow_islands(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("wait", S.paced(F.col("value") * 10, 250.0, 2000.0, 0.5))
    got = S.run_length(e, ["user_id"], ["at", "event_id"], F.col("wait") > 500)
    return got.select("event_id", "wait", F.col("run").cast("long").alias("run"), (F.col("run") >= 3).alias("slow"))


def last_two_equal(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    same = (F.lag("event_type").over(w) == F.col("event_type")) & (F.abs(F.lag("value").over(w) - F.col("value")) < 5)
    return events(spark, sf).select("event_id", F.coalesce(same, F.lit(False)).alias("same"))


def ring_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and greatest of the last 200 values of each user."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-199, 0)
    return events(spark, sf).select("event_id", F.round(F.avg("value").over(w), 9).alias("mean"), F.max("value").over(w).alias("most"))


def session_split(spark: SparkSession, sf: str) -> DataFrame:
    got = S.sessions(events(spark, sf), ["user_id"], "at", "event_id", 86_400.0)
    return got.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def spread_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.spread(events(spark, sf), ["event_type"], "event_id", 25).select("event_type", "event_id")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    entity = F.when(F.col("event_type").isin("view", "error"), F.lit(None)).when(F.col("event_type") == "signup", 2).otherwise(1)
    return e.select(
        "user_id", F.floor(F.col("at") / 86400).alias("day"), F.col("event_id").alias("seq"), entity.cast("long").alias("entity_id"), (F.col("value") >= 20).alias("sure"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"), (F.col("k") % 2 == 0).alias("moving"),
    )


def vote_settle(spark: SparkSession, sf: str) -> DataFrame:
    states = S.settled_votes(readings(spark, sf), ["user_id", "day"], "seq")
    return S.vote_outcomes(states, ["user_id", "day"], "seq").select("user_id", "day", "seq", "state", "entity_id", "reads")


def track_label(spark: SparkSession, sf: str) -> DataFrame:
    """A label for tracks with two sure readings that all agree, and how many members take it from others."""
    r = readings(spark, sf)
    sure = F.col("sure") & F.col("entity_id").isNotNull()
    g = r.groupBy("user_id", "day").agg(
        F.count("*").alias("members"), F.count_if(sure).alias("n_sure"), F.min(F.when(sure, F.col("entity_id"))).alias("low"), F.max(F.when(sure, F.col("entity_id"))).alias("high")
    )
    good = (F.col("n_sure") >= 2) & (F.col("low") == F.col("high"))
    return g.select("user_id", "day", F.when(good, F.col("low")).alias("entity_id"), F.when(good, F.col("members") - F.col("n_sure")).otherwise(0).alias("propagated"))


def detect_reason(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    since = F.col("at") - F.lag("at").over(w)
    reason = F.when(since.isNull(), "first").when(F.col("event_type") == "click", "settled").when(since >= 40_000, "refresh")
    return events(spark, sf).select("event_id", reason.alias("reason"))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Latest correction of every entry, kept where it differs from the first guess."""
    e = events(spark, sf)
    staged = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("guess"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("said"))
    return staged.join(last, "user_id").where("guess <> said")


def admission_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's requests: one a minute and three a day are accepted, none while paused; waiting ones do not count."""
    e = events(spark, sf).withColumn("paused", F.col("k") >= 90)
    return S.admitted(e, ["user_id"], 1, 3)


_E = """e AS (SELECT event_id, user_id, event_type, round(value, 6) AS value, round(epoch_us(ts) / 1e6, 6) AS tm, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
_APP = f"""{_E}, m AS (SELECT *, CASE WHEN value - max(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 20 THEN 1 ELSE 0 END AS again FROM e),
app AS (SELECT user_id, event_type, arg_min(value, event_id) AS first_time, max(value) AS last_time, CAST(sum(again) + 1 AS BIGINT) AS appearances, min(event_id) AS first_id FROM m GROUP BY ALL)"""
_READ = f"""{_E}, r AS (SELECT user_id, CAST(floor(tm / 86400) AS BIGINT) AS day, event_id AS seq, CASE WHEN event_type IN ('view', 'error') THEN NULL WHEN event_type = 'signup' THEN 2 ELSE 1 END::BIGINT AS entity_id,
  value >= 20 AS sure, least(1.0, value / 100) AS score, k % 2 = 0 AS moving FROM e)"""
_ALL = (
    rescan_collapse, newest_rows, dual_cap, appearances, session_log, rate_slots, slow_islands, last_two_equal, ring_stats, session_split, spread_sample,
    vote_settle, track_label, detect_reason, corrections, admission_gate,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "rescan_collapse": f"WITH {_E}, m AS (SELECT *, lead(event_type) OVER w = event_type AND lead(tm) OVER w - tm <= 40000 AS again FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)) SELECT event_id, user_id, event_type FROM m WHERE NOT coalesce(again, false)",
    "newest_rows": f"WITH {_E} SELECT user_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, event_id DESC) <= 10",
    "dual_cap": f"WITH {_E}, m AS (SELECT *, row_number() OVER w AS n, sum(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm DESC, event_id DESC)) SELECT user_id, event_id, k FROM m WHERE n = 1 OR (n <= 15 AND s <= 500)",
    "appearances": f"WITH {_APP} SELECT user_id, event_type, first_time, last_time, appearances FROM app",
    "session_log": f"WITH {_APP} SELECT user_id, CAST(place AS INTEGER) AS place, event_type, appearances FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id DESC) AS place FROM app) WHERE place <= 3",
    "rate_slots": f"WITH {_E}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) - 1 AS i FROM e) SELECT event_id, round(max(tm - i * 30000.0) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 30000.0, 3) AS slot FROM m",
    "slow_islands": f"""WITH {_E}, m AS (SELECT *, CAST(floor(least(2000.0, greatest(250.0, value * 10 / 0.5)) + 0.5) AS BIGINT) AS wait FROM e),
g AS (SELECT *, sum(CASE WHEN wait > 500 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS g FROM m)
SELECT event_id, wait, CAST(sum(CASE WHEN wait > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY tm, event_id) AS BIGINT) AS run,
  sum(CASE WHEN wait > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY tm, event_id) >= 3 AS slow FROM g""",
    "last_two_equal": f"WITH {_E} SELECT event_id, coalesce(lag(event_type) OVER w = event_type AND abs(lag(value) OVER w - value) < 5, false) AS same FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "ring_stats": f"WITH {_E} SELECT event_id, round(avg(value) OVER w, 9) AS mean, max(value) OVER w AS most FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "session_split": f"""WITH {_E}, j AS (SELECT *, coalesce(abs(tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id)) > 86400, false)::INT AS j FROM e),
s AS (SELECT *, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS BIGINT) AS session FROM j) SELECT user_id, session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY ALL""",
    "spread_sample": f"""WITH {_E}, m AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM e)
SELECT event_type, event_id FROM m WHERE n % greatest(1, c // 25) = 0 AND n // greatest(1, c // 25) < 25""",
    "vote_settle": f"""WITH {_READ}, a AS (SELECT *, count(*) FILTER (WHERE sure AND entity_id IS NOT NULL) OVER w AS n_sure, min(CASE WHEN sure THEN entity_id END) OVER w AS low, max(CASE WHEN sure THEN entity_id END) OVER w AS high,
  max(CASE WHEN sure AND entity_id IS NOT NULL THEN score END) OVER w AS best, count(entity_id) OVER w AS n_read, count(*) FILTER (WHERE entity_id IS NOT NULL OR NOT moving) OVER w AS n_still, count(*) OVER w AS reads,
  NOT sure AND NOT lag(sure) OVER o AND entity_id IS NOT DISTINCT FROM lag(entity_id) OVER o AND abs(score - lag(score) OVER o) < 0.001 AND lag(sure) OVER o IS NOT NULL AS same
  FROM r WINDOW w AS (PARTITION BY user_id, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY user_id, day ORDER BY seq)),
s AS (SELECT *, CASE WHEN n_sure > 0 AND low = high AND (n_sure >= 2 OR best >= 0.86) THEN 'promoted'
  WHEN CASE WHEN n_sure > 0 THEN n_read ELSE n_still END >= 4 OR reads >= 12 OR coalesce(same, false) THEN 'rejected' ELSE 'voting' END AS state FROM a)
SELECT user_id, day, seq, state, CASE WHEN state = 'promoted' THEN low END AS entity_id, reads FROM s
QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY state = 'voting', CASE WHEN state = 'voting' THEN -seq ELSE seq END) = 1""",
    "track_label": f"""WITH {_READ}, g AS (SELECT user_id, day, count(*) AS members, count(*) FILTER (WHERE sure AND entity_id IS NOT NULL) AS n_sure, min(CASE WHEN sure THEN entity_id END) AS low, max(CASE WHEN sure THEN entity_id END) AS high FROM r GROUP BY ALL)
SELECT user_id, day, CASE WHEN n_sure >= 2 AND low = high THEN low END AS entity_id, CASE WHEN n_sure >= 2 AND low = high THEN members - n_sure ELSE 0 END AS propagated FROM g""",
    "detect_reason": f"WITH {_E} SELECT event_id, CASE WHEN lag(tm) OVER w IS NULL THEN 'first' WHEN event_type = 'click' THEN 'settled' WHEN tm - lag(tm) OVER w >= 40000 THEN 'refresh' END AS reason FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)",
    "corrections": f"WITH {_E} SELECT user_id, arg_min(event_type, event_id) AS guess, arg_max(event_type, event_id) AS said FROM e GROUP BY user_id HAVING guess <> said",
    "admission_gate": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) AS i FROM e),
g AS (
  SELECT user_id, event_id, i, CASE WHEN k >= 90 THEN [] ELSE [tm] END AS recent, floor(tm / 86400) AS day, CASE WHEN k >= 90 THEN 0 ELSE 1 END AS cnt, CASE WHEN k >= 90 THEN 'paused' ELSE 'ok' END AS answer FROM n WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN answer = 'ok' THEN list_append(rec, tm) ELSE rec END, nday, CASE WHEN answer = 'ok' THEN c0 + 1 ELSE c0 END, answer FROM (
    SELECT *, CASE WHEN k >= 90 THEN 'paused' WHEN len(rec) >= 1 THEN 'busy' WHEN c0 >= 3 THEN 'daily-limit' ELSE 'ok' END AS answer FROM (
      SELECT n.user_id, n.event_id, n.i, n.tm, n.k, list_filter(g.recent, lambda t: t > n.tm - 60) AS rec, floor(n.tm / 86400) AS nday, CASE WHEN g.day = floor(n.tm / 86400) THEN g.cnt ELSE 0 END AS c0
      FROM g JOIN n ON n.user_id = g.user_id AND n.i = g.i + 1) x) y
) SELECT user_id, event_id, answer FROM g""",
}
