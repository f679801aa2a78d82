"""Queries of the remaining live and catalogue rules: votes, logs, seeks, reads per cycle, kinds and denied rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.operators import checks as C
from entrack.operators import sequences as S
from entrack.operators import zones as Z
from entrack.plans.catalogue import ORACLES as CATALOGUE_ORACLES
from entrack.plans.catalogue import name_search_tiers
from entrack.plans.retrieval import ORACLES as RETRIEVAL_ORACLES
from entrack.plans.retrieval import placeholder_filter
from entrack.plans.sequences import _E, events
from entrack.plans.spatial import _B, boxes
from entrack.sources.tables import table
from entrack.streaming.stateful import samples_from

#: Score and lead from which a cut item's read counts as sure, and the score from which it counts alone.
CUT_SCORE, CUT_LEAD, CUT_ALONE = 0.66, 0.1, 0.8
#: Entries a session's log keeps, and the jump in seconds that starts a new one.
LOG_ENTRIES, JUMP = 200, 2.0


def indexable(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that an index may hold: not of the excluded kind and not denied."""
    denied = table(spark, sf, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("p_partkey"))
    return table(spark, sf, "part").where("p_type <> 'PROMO'").join(denied, "p_partkey", "left_anti").select("p_partkey", "p_type")


def placeholders_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """The entities' rows without those that look like the placeholder; the sentinel row itself stays."""
    rows = placeholder_filter(spark, sf)
    return rows.where("item_id = 0 or not placeholder").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("item_id").alias("last"))


def reads_per_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Eight boxes of each frame for a cycle: the least read ones first, then the larger."""
    w = Window.partitionBy("frame").orderBy("reads", (F.col("w") * F.col("h")).desc(), "box_id")
    b = boxes(spark, sf).withColumn("reads", F.col("box_id") % 4)
    return b.withColumn("place", F.row_number().over(w)).where("place <= 8").select("frame", "place", "box_id", "reads")


def search_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Search results whose entity the catalogue still has."""
    have = table(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"))
    return name_search_tiers(spark, sf).join(have, "id", "left_semi")


def vote_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as votes: sure ones, and unsure ones of cut items with enough score and lead, alone from a high score on."""
    e, k = events(spark, sf), F.col("k")
    score, lead = F.round(k / 100, 6), F.round(F.col("value") / 100, 6)
    entity = F.when(k % 10 > 0, F.col("user_id"))
    usable = entity.isNotNull() & (F.col("event_type") != "error") & (k % 7 > 0)
    sure = usable & (F.col("value") >= 50)
    cut = usable & ~sure & (k % 2 == 0) & (score >= CUT_SCORE) & (lead >= CUT_LEAD)
    counted = F.when(entity.isNull() | (cut & (score < CUT_ALONE)), F.lit(None)).otherwise(score)
    return e.select("event_id", entity.alias("entity_id"), (sure | cut).alias("sure"), counted.alias("score"))


def session_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's log on a page that they come back to: entries of all visits, newest first, LOG_ENTRIES at most."""
    e = events(spark, sf).withColumn("entity", F.concat_ws(":", "event_type", "k"))
    log = S.appearances(e, ["user_id", "entity"], "value", ["event_id"], 20.0)
    first = e.groupBy("user_id", "entity").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy(F.col("first_id").desc())
    placed = log.join(first, ["user_id", "entity"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= LOG_ENTRIES)
    return placed.select("user_id", "place", "entity", "first_time", "last_time", "appearances")


def seek_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A new session where the media time moved further than the clock times the playback rate allows."""
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = events(spark, sf).withColumn("media", F.col("value") * 1000).withColumn("rate", F.when(F.col("k") % 2 == 0, 1.0).otherwise(0.5))
    off = F.abs(F.round(F.col("media") - F.lag("media").over(w) - (F.col("at") - F.lag("at").over(w)) * F.col("rate"), 3)) > JUMP * 10_000
    marked = e.withColumn("j", F.coalesce(off.cast("int"), F.lit(0))).withColumn("session", F.sum("j").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


#: Zones of the events read as frames, and seconds that a unit of an event's value lasts as a cycle.
ZONES, CYCLE = 16, 400.0


def zone_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a sample of its user's frame: cuts mark all zones, the others move and settle by themselves."""
    e = events(spark, sf)
    rows = samples_from(e, ZONES).join(e.select(F.col("event_id").alias("seq"), "at"), "seq")
    return Z.gated(rows, "session", ["at", "seq"]).select("session", "seq", "sample", "result", "settled", "n_moving")


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Views and clicks as cycles that begin with the event and end after its value, every third result delivered twice; errors as cuts."""
    e = events(spark, sf).withColumn("end", F.round(F.col("at") + F.col("value") * CYCLE, 3))
    cut = e.where("event_type = 'error'").select(F.col("user_id").alias("session"), F.col("event_id").alias("cycle"), F.lit("cut").alias("kind"), F.round("at", 3).alias("at"))
    run = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("session"), F.col("event_id").alias("cycle"), F.round("at", 3).alias("at"), "end", "k")
    begin = run.select("session", "cycle", F.lit("begin").alias("kind"), "at")
    result = run.select("session", "cycle", F.lit("result").alias("kind"), F.col("end").alias("at"))
    again = run.where("k % 3 = 0").select("session", "cycle", F.lit("result").alias("kind"), (F.col("end") + 60).alias("at"))
    return cut.unionByName(begin).unionByName(result).unionByName(again)


def current_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of cycles in which their session was not cut, each once."""
    return Z.current(cycles(spark, sf), "session", "cycle", "kind", "at").select("session", "cycle", F.round("begun", 3).alias("begun"), F.round("ended", 3).alias("ended"))


#: Limits in seconds of the events' clock, whose rows of a user lie hours apart.
CHECKS = C.Limits(rest=10_000.0, tries=3, reads=8, cover=90_000.0)


def check_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames of a user's listed item: where the pointer is, whether its spot is quiet, and what a read would say."""
    e, k = events(spark, sf), F.col("k")
    paused = F.col("event_type") == "purchase"
    media = F.when(paused, F.floor(F.col("at") / 200_000) * 200_000).otherwise(F.col("at"))
    entity = F.when(k % 5 == 0, F.lit(None)).otherwise(F.when(k % 5 < 2, 1).otherwise(k % 5)).cast("double")
    return e.select(
        "user_id", F.col("event_id").alias("seq"), "at", media.alias("media"), (k > 20).alias("over"), (F.col("event_type") == "view").alias("quiet"), paused.alias("paused"),
        entity.alias("entity"), (F.col("value") >= 15).alias("sure"), F.least(F.col("value") / 200, F.lit(1.0)).alias("score"),
    )


def item_checks(spark: SparkSession, sf: str) -> DataFrame:
    return C.checked(check_rows(spark, sf), "user_id", 1, CHECKS)


_ALL = (indexable, placeholders_dropped, reads_per_cycle, search_guarded, vote_readings, session_logs, seek_sessions, zone_cuts, current_results, item_checks)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "indexable": "SELECT p_partkey, p_type FROM part WHERE p_type <> 'PROMO' AND p_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)",
    "placeholders_dropped": f"SELECT entity_id, count(*) AS n, max(item_id) AS last FROM ({RETRIEVAL_ORACLES['placeholder_filter']}) WHERE item_id = 0 OR NOT placeholder GROUP BY 1",
    "reads_per_cycle": f"WITH {_B} SELECT frame, CAST(place AS INTEGER) AS place, box_id, box_id % 4 AS reads FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY box_id % 4, w * h DESC, box_id) AS place FROM b) WHERE place <= 8",
    "search_guarded": f"SELECT * FROM ({CATALOGUE_ORACLES['name_search_tiers']}) WHERE id IN (SELECT p_partkey FROM part WHERE p_size < 40)",
    "vote_readings": f"""WITH {_E}, r AS (SELECT event_id, CASE WHEN k % 10 > 0 THEN user_id END AS entity_id, k % 10 > 0 AND event_type <> 'error' AND k % 7 > 0 AS usable, round(k / 100, 6) AS score, round(value / 100, 6) AS lead, value >= 50 AS good, k FROM e),
c AS (SELECT *, usable AND good AS sure, usable AND NOT good AND k % 2 = 0 AND score >= {CUT_SCORE}::DOUBLE AND lead >= {CUT_LEAD}::DOUBLE AS cut FROM r)
SELECT event_id, entity_id, sure OR cut AS sure, CASE WHEN entity_id IS NULL OR (cut AND score < {CUT_ALONE}::DOUBLE) THEN NULL ELSE score END AS score FROM c""",
    "session_logs": f"""WITH {_E}, x AS (SELECT *, event_type || ':' || k AS entity FROM e), m AS (SELECT *, CASE WHEN value - max(value) OVER (PARTITION BY user_id, entity ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 20 THEN 1 ELSE 0 END AS again FROM x),
a AS (SELECT user_id, entity, arg_min(value, event_id) AS first_time, max(value) AS last_time, CAST(sum(again) + 1 AS BIGINT) AS appearances, min(event_id) AS first_id FROM m GROUP BY ALL)
SELECT user_id, CAST(place AS INTEGER) AS place, entity, first_time, last_time, appearances FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id DESC) AS place FROM a) WHERE place <= {LOG_ENTRIES}""",
    "seek_sessions": f"""WITH {_E}, j AS (SELECT *, coalesce(abs(round(value * 1000 - lag(value * 1000) OVER w - (tm - lag(tm) OVER w) * CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 3)) > {JUMP * 10_000}, false)::INT AS j FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id)),
s AS (SELECT *, CAST(sum(j) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM j) SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY ALL""",
    "zone_cuts": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id) AS sample FROM e),
c AS (SELECT *, event_type <> 'error' AND sample > 1 AS compared, value / 4 >= {Z.CUT} AS big FROM n),
z AS (SELECT user_id, sample, big, unnest(range({ZONES})) AS zone, k, event_id FROM c WHERE compared),
d AS (SELECT user_id, sample, zone, big, ((k * 7 + zone * 31 + event_id * 3) % 97) / 10 AS d FROM z),
m AS (SELECT *, big OR d >= {Z.MOVING} AS hit, NOT big AND d < {Z.QUIET} AND coalesce(lag(NOT big AND d < {Z.QUIET}) OVER (PARTITION BY user_id, zone ORDER BY sample), false) AS calm FROM d),
s AS (SELECT *, coalesce(max(CASE WHEN hit THEN sample END) OVER w, 0) > coalesce(max(CASE WHEN calm THEN sample END) OVER w, 0) AS now FROM m WINDOW w AS (PARTITION BY user_id, zone ORDER BY sample)),
l AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id, zone ORDER BY sample), false) AS was FROM s),
g AS (SELECT user_id, sample, sum(now::INT - was::INT) AS change, count(*) FILTER (WHERE was AND NOT now) AS settled FROM l GROUP BY ALL)
SELECT c.user_id AS session, event_id AS seq, CAST(sample AS INTEGER) AS sample, CASE WHEN compared AND big THEN 'cut' WHEN compared THEN 'ok' ELSE 'first' END AS result, coalesce(settled, 0) AS settled,
CAST(coalesce(sum(change) OVER (PARTITION BY c.user_id ORDER BY sample), 0) AS BIGINT) AS n_moving FROM c LEFT JOIN g USING (user_id, sample)""",
    "current_results": f"""WITH {_E}, r AS (SELECT user_id AS session, event_id AS cycle, round(tm, 3) AS begun, round(tm + value * {CYCLE}, 3) AS ended FROM e WHERE event_type IN ('view', 'click')),
c AS (SELECT user_id AS session, round(tm, 3) AS at FROM e WHERE event_type = 'error')
SELECT session, cycle, round(begun, 3) AS begun, round(ended, 3) AS ended FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session = r.session AND c.at > r.begun AND c.at <= r.ended)""",
}
