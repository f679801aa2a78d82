"""Queries on outlines, on the parts of a selection and on what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entrack.operators import geometry as G
from entrack.operators import outlines as O  # noqa: E741
from entrack.operators import ranking as R
from entrack.plans.retrieval import _IDX, lists
from entrack.plans.sequences import events
from entrack.plans.spatial import _B, boxes


def _quad(turn: float = 0.0, dx: float = 0.0, dy: float = 0.0, grow: float = 1.0):  # noqa: ANN202
    return G.corners(F.col("x") + dx, F.col("y") + dy, F.col("w") * grow, F.col("h") * grow, F.col("conf") * 45 + turn)


def aligned_corners(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines read from some corner and in some direction, put in order, and then beside a reading a little aside."""
    b = boxes(spark, sf).withColumn("straight", _quad())
    start = F.pmod(F.col("box_id"), F.lit(4))
    shuffled = F.when(start == 0, O.cycled(F.col("straight"), 0)).when(start == 1, O.cycled(F.col("straight"), 1)).when(start == 2, O.cycled(F.col("straight"), 2)).otherwise(O.cycled(F.col("straight"), 3))
    b = b.withColumn("given", F.when(F.col("box_id") % 3 == 0, F.reverse(shuffled)).otherwise(shuffled))
    b = b.withColumn("given", O.clockwise(F.col("given"))).withColumn("ordered", O.from_short_side(F.col("given")))
    b = b.withColumn("back", O.aligned(F.col("ordered"), _quad(9.0, 3.0, -2.0)))
    at = lambda c, i, a: F.round(F.col(c)[i][a], 5).alias(f"{c}_{'xy'[a]}{i}")
    return b.select("box_id", *[at(c, i, a) for c in ("ordered", "back") for i in (0, 2) for a in (0, 1)], O.quarter_turns(F.col("ordered")).alias("turns"))


def click_redetect(spark: SparkSession, sf: str) -> DataFrame:
    """Every box is clicked; looking again finds it turned, moved and grown in several ways, some of them face down."""
    b = boxes(spark, sf)
    clicks = b.select("box_id", _quad().alias("quad"), F.when(F.col("box_id") % 2 == 0, F.col("x") + 2).alias("px"), F.when(F.col("box_id") % 2 == 0, F.col("y") + 2).alias("py"))
    ways = [(0, 35.0, 2.0, 1.0, 1.0), (1, -28.0, -4.0, 3.0, 1.1), (2, 4.0, 12.0, -9.0, 0.9), (3, 60.0, 40.0, 30.0, 1.0)]
    made = F.array(*[F.struct(F.lit(k).alias("n"), _quad(turn, dx, dy, grow).alias("quad")) for k, turn, dx, dy, grow in ways])
    found = b.select("box_id", F.explode(made).alias("m")).select(F.col("box_id").alias("click_id"), (F.col("box_id") * 4 + F.col("m.n")).alias("box_id"), F.pmod(F.col("box_id") * 7 + F.col("m.n") * 5, F.lit(11)).alias("place"), F.when((F.col("box_id") + F.col("m.n") * 2) % 3 == 0, "down").otherwise("up").alias("kind"), F.col("m.quad").alias("quad"))
    return O.redetected(clicks.withColumnRenamed("box_id", "click_id"), found, "click_id")


def cut_corners(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of a selection that are the picture's own, and those that an outline's corners come near."""
    b = boxes(spark, sf)
    inner = [F.when(F.col("box_id") % 50 == 7, F.lit(None)).otherwise(F.pmod(F.col(c), F.lit(40.0))) for c in "xy"] + [F.col("w"), F.col("h")]
    width, height = F.pmod(F.col("x"), F.lit(40.0)) + F.col("w") + F.pmod(F.col("box_id"), F.lit(9)), F.pmod(F.col("y"), F.lit(40.0)) + F.col("h") + F.pmod(F.col("box_id"), F.lit(7))
    quad = G.corners(F.pmod(F.col("x"), F.lit(40.0)) + F.col("w") / 2, F.pmod(F.col("y"), F.lit(40.0)) + F.col("h") / 2, F.col("w"), F.col("h"), F.col("conf") * 45)
    b = b.select("box_id", width.alias("width"), height.alias("height"), O.short_sides(width, height, inner).alias("short"), quad.alias("quad"))
    reached = O.sides_reached(F.col("quad"), F.col("width"), F.col("height"), F.col("short"), 0.5)
    return b.select("box_id", F.array_join("short", ",").alias("short"), F.array_join(reached, ",").alias("reached"))


def crop_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The parts to read of a selection around every box, with none, one or two straightened views."""
    b, k = boxes(spark, sf), F.col("box_id")
    inner = F.when(k % 5 > 0, F.struct((F.col("w") * 0.1).alias("x"), (F.col("h") * 0.2).alias("y"), (F.col("w") * 0.8).alias("w"), F.col("h").alias("h")))
    views = F.when(k % 3 == 1, F.array(F.struct(F.lit(590.0).alias("w"), F.lit(860.0).alias("h")))).when(k % 3 == 2, F.array(F.struct(F.lit(590.0).alias("w"), F.lit(860.0).alias("h")), F.struct(F.col("w").alias("w"), F.col("h").alias("h"))))
    rows = b.select("box_id", F.col("w").alias("width"), F.col("h").alias("height"), inner.alias("inner"), views.alias("views"), (k % 4 > 0).alias("art_too"), (k % 2 == 0).alias("box_too"))
    return O.crops(rows, "box_id")


def shown_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    e, k = events(spark, sf), F.col("k")
    outcome = F.element_at(F.array(*[F.lit(o) for o in ("confident", "unsure", "no-outline", "error", "nothing", "down", "confident")]), (k % 7 + 1).cast("int"))
    label = O.shown_verdict(outcome, F.when(k % 5 > 0, k % 3), F.when(k % 11 > 0, F.col("user_id") % 3))
    return e.groupBy(label.alias("verdict")).agg(F.count("*").alias("n"))


#: For the test tables, whose best scores lie around 0.35, and where an entity stands for the sentinel.
_FLOOR, _LEAD, _ASIDE = 0.33, 0.03, 3


def rescue_answers(spark: SparkSession, sf: str) -> DataFrame:
    return R.rescued(lists(spark, sf), _FLOOR, _LEAD, _ASIDE)


def followed_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of the boxes that are up and large, in sessions of at most fifty frames of ten boxes."""
    from entrack.streaming.processors import followed, tracked

    return tracked(followed(followed_frames(spark, sf), 1200.0))


def followed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Ten boxes of neighbouring ids a frame, fifty such frames a session; all boxes lie close together."""
    b = boxes(spark, sf).withColumn("quad", G.corners(F.col("x") / 10, F.col("y") / 10, F.col("w"), F.col("h"), F.col("conf") * 45)).withColumn("o", G.bounds(F.col("quad")))
    one = F.struct(F.col("box_id").alias("id"), *[F.col(f"o.{c}").alias(c) for c in "xywh"], F.when(F.col("box_id") % 5 == 0, "down").otherwise("up").alias("kind"), F.greatest("w", "h").alias("long_side"))
    return b.groupBy(F.floor(F.col("box_id") / 500).alias("session"), F.floor(F.col("box_id") / 10).alias("frame")).agg(F.sort_array(F.collect_list(one)).alias("boxes"))


_ALL = (aligned_corners, click_redetect, cut_corners, crop_parts, shown_verdicts, rescue_answers, followed_tracks)
QUERIES = {f.__name__: f for f in _ALL}


def _corner(cx: str, cy: str, angle: str, i: int) -> str:
    """A corner of a turned box b as a list of two."""
    dx, dy = ("-w/2", "-h/2") if i == 0 else ("w/2", "-h/2") if i == 1 else ("w/2", "h/2") if i == 2 else ("-w/2", "h/2")
    return f"[{cx} + ({dx}) * cos(radians({angle})) - ({dy}) * sin(radians({angle})), {cy} + ({dx}) * sin(radians({angle})) + ({dy}) * cos(radians({angle}))]"


def _ring(cx: str, cy: str, angle: str) -> str:
    return "[" + ", ".join(_corner(cx, cy, angle, i) for i in range(4)) + "]"


_FAR = "round(" + " + ".join(f"sqrt(power(q[(({i} + k) % 4 + 1)::INT][1] - r[{i + 1}][1], 2) + power(q[(({i} + k) % 4 + 1)::INT][2] - r[{i + 1}][2], 2))" for i in range(4)) + ", 9)"
_ASPECT = "(59.0::DOUBLE / 86.0::DOUBLE)"
_SPAN = "greatest(0.0::DOUBLE, floor({0} + 0.5::DOUBLE))"
ORACLES = {
    # a box's corners go clockwise from its top left, so a short side begins at corner 0 or 2 where w <= h, else at 3 or 1
    "aligned_corners": f"""WITH {_B}, g AS (SELECT *, {_ring("x", "y", "conf * 45")} AS c, {_ring("(x + 3)", "(y - 2)", "(conf * 45 + 9)")} AS r, CASE WHEN box_id % 3 = 0 THEN (box_id % 4 + 3) % 4 ELSE box_id % 4 END AS s FROM b),
o AS (SELECT *, CASE WHEN w = h OR (w < h) = (s % 2 = 0) THEN s ELSE (s + 3) % 4 END AS f FROM g),
q AS (SELECT *, [c[((f + 0) % 4 + 1)::INT], c[((f + 1) % 4 + 1)::INT], c[((f + 2) % 4 + 1)::INT], c[((f + 3) % 4 + 1)::INT]] AS q FROM o),
n AS (SELECT q.*, k, row_number() OVER (PARTITION BY box_id ORDER BY {_FAR}, k) AS n FROM q, (SELECT unnest(range(4)) AS k))
SELECT box_id, {", ".join(f"round(q[{i + 1}][{a + 1}], 5) AS ordered_{'xy'[a]}{i}, round(q[((k + {i}) % 4 + 1)::INT][{a + 1}], 5) AS back_{'xy'[a]}{i}" for i in (0, 2) for a in (0, 1))},
CAST(((floor(-degrees(atan2(q[2][2] - q[1][2], q[2][1] - q[1][1])) / 90 + 0.5::DOUBLE)::INT % 4 + 4) % 4) * 90 AS INTEGER) AS turns FROM n WHERE n = 1""",
    "cut_corners": f"""WITH {_B}, i AS (SELECT box_id, conf, w, h, x - 40 * floor(x / 40) AS ix, y - 40 * floor(y / 40) AS iy FROM b), v AS (SELECT *, ix + w + box_id % 9 AS wide, iy + h + box_id % 7 AS high, {_ring("(ix + w / 2)", "(iy + h / 2)", "conf * 45")} AS q FROM i),
s AS (SELECT box_id, unnest([1, 2, 3, 4]) AS n, unnest(['left', 'top', 'right', 'bottom']) AS side, unnest([ix, iy, wide - (ix + w), high - (iy + h)]) AS room, unnest([w, h, w, h]) AS size,
unnest([list_min(list_transform(q, lambda p: p[1])), list_min(list_transform(q, lambda p: p[2])), list_min(list_transform(q, lambda p: wide - p[1])), list_min(list_transform(q, lambda p: high - p[2]))]) AS inset FROM v),
t AS (SELECT *, box_id % 50 <> 7 AND room < 0.04::DOUBLE * size - 0.5 AS short FROM s)
SELECT box_id, coalesce(string_agg(side, ',' ORDER BY n) FILTER (WHERE short), '') AS short, coalesce(string_agg(side, ',' ORDER BY n) FILTER (WHERE short AND inset <= 0.5), '') AS reached FROM t GROUP BY 1""",
    # candidates as rows: (place, part, view, turn) and the picture and rectangle they are cut from
    "crop_parts": f"""WITH {_B}, r AS (SELECT box_id, w AS pw, h AS ph, box_id % 3 AS seen, box_id % 4 > 0 AS art_too, box_id % 2 = 0 AS box_too, box_id % 5 > 0 AS given,
  greatest(0.0::DOUBLE, w * 0.1::DOUBLE) AS x0, greatest(0.0::DOUBLE, h * 0.2::DOUBLE) AS y0, least(w, w * 0.1::DOUBLE + w * 0.8::DOUBLE) AS x1, least(h, h * 0.2::DOUBLE + h) AS y1, 0.04::DOUBLE / (1 + 2 * 0.04::DOUBLE) AS t FROM b),
u AS (SELECT *, CASE WHEN given THEN x0 ELSE pw * t END AS bx, CASE WHEN given THEN y0 ELSE ph * t END AS "by", CASE WHEN given THEN x1 - x0 ELSE pw * (1 - 2 * t) END AS bw, CASE WHEN given THEN y1 - y0 ELSE ph * (1 - 2 * t) END AS bh FROM r),
s AS (SELECT *, CASE WHEN abs(bw / bh - {_ASPECT}) <= 0.12::DOUBLE THEN 'upright' WHEN abs(bh / bw - {_ASPECT}) <= 0.12::DOUBLE THEN 'sideways' ELSE 'other' END AS shape, seen = 0 OR box_too AS boxed FROM u),
f AS (SELECT *, least(bw, bh * {_ASPECT}) AS fw, least(bw, bh * (1 / {_ASPECT})) AS lw FROM s),
c AS (
  SELECT box_id, 1 AS grp, v AS ord, 'item' AS part, v AS view, turn, CASE WHEN v = 0 THEN 590.0 ELSE pw END AS wide, CASE WHEN v = 0 THEN 860.0 ELSE ph END AS high, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, CASE WHEN v = 0 THEN 590.0 ELSE pw END AS w, CASE WHEN v = 0 THEN 860.0 ELSE ph END AS h
    FROM f, (VALUES (0), (1)) a(v), (VALUES (0), (180)) t(turn) WHERE v < seen
  UNION ALL SELECT box_id, 2, 0, 'whole', NULL, turn, pw, ph, bx, "by", bw, bh FROM f, (VALUES ('upright', 0), ('upright', 180), ('sideways', 90), ('sideways', 270)) t(way, turn) WHERE boxed AND shape = way
  UNION ALL SELECT box_id, 3, 0, 'fit', NULL, turn, pw, ph, bx + (bw - fw) / 2, "by" + (bh - fw / {_ASPECT}) / 2, fw, fw / {_ASPECT} FROM f, (VALUES (0), (180)) t(turn) WHERE boxed AND shape = 'other' AND bw / bh <= 1.1::DOUBLE
  UNION ALL SELECT box_id, 4, 0, 'fit', NULL, turn, pw, ph, bx + (bw - lw) / 2, "by" + (bh - lw / (1 / {_ASPECT})) / 2, lw, lw / (1 / {_ASPECT}) FROM f, (VALUES (90), (270)) t(turn) WHERE boxed AND shape = 'other' AND bw / bh >= 0.9::DOUBLE
  UNION ALL SELECT box_id, 5, 0, 'square', NULL, turn, pw, ph, bx, "by", bw, bh FROM f, (VALUES (0), (180)) t(turn) WHERE boxed AND (shape = 'other' OR (seen = 0 AND art_too))),
t AS (SELECT *, turn IN (90, 270) AS side, CASE turn WHEN 0 THEN x WHEN 90 THEN high - y - h WHEN 180 THEN wide - x - w ELSE y END AS tx, CASE turn WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN high - y - h ELSE wide - x - w END AS ty FROM c),
a AS (SELECT *, CASE WHEN side THEN h ELSE w END AS tw, CASE WHEN side THEN w ELSE h END AS th, CASE WHEN side THEN high ELSE wide END AS vw, CASE WHEN side THEN wide ELSE high END AS vh FROM t),
p AS (SELECT *, CASE WHEN part = 'square' THEN tx + (tw - least(tw, th)) / 2 ELSE tx + 0.118::DOUBLE * tw END AS ax, CASE WHEN part = 'square' THEN ty + (th - least(tw, th)) / 2 ELSE ty + 0.181::DOUBLE * th END AS ay,
  CASE WHEN part = 'square' THEN least(tw, th) ELSE 0.765::DOUBLE * tw END AS aw, CASE WHEN part = 'square' THEN least(tw, th) ELSE 0.525::DOUBLE * th END AS ah FROM a),
l AS (SELECT *, least(vw - 1, {_SPAN.format("ax")}) AS px, least(vh - 1, {_SPAN.format("ay")}) AS py FROM p),
z AS (SELECT *, least(vw, greatest(px + 1, floor(ax + aw + 0.5::DOUBLE))) - px AS qw, least(vh, greatest(py + 1, floor(ay + ah + 0.5::DOUBLE))) - py AS qh FROM l)
SELECT box_id, CAST(row_number() OVER (PARTITION BY box_id ORDER BY grp, CASE WHEN grp = 1 THEN turn ELSE 0 END, ord, turn) - 1 AS INTEGER) AS place, part, CAST(view AS INTEGER) AS view, CAST(turn AS INTEGER) AS turn,
CAST(CASE turn WHEN 0 THEN px WHEN 90 THEN py WHEN 180 THEN wide - px - qw ELSE wide - py - qh END AS INTEGER) AS x, CAST(CASE turn WHEN 0 THEN py WHEN 90 THEN high - px - qw WHEN 180 THEN high - py - qh ELSE px END AS INTEGER) AS y,
CAST(CASE WHEN side THEN qh ELSE qw END AS INTEGER) AS w, CAST(CASE WHEN side THEN qw ELSE qh END AS INTEGER) AS h FROM z""",
    "shown_verdicts": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), o AS (SELECT ['confident', 'unsure', 'no-outline', 'error', 'nothing', 'down', 'confident'][k % 7 + 1] AS outcome, CASE WHEN k % 5 > 0 THEN k % 3 END AS truth, CASE WHEN k % 11 > 0 THEN user_id % 3 END AS top FROM e)
SELECT CASE WHEN outcome = 'no-outline' THEN 'no outline' WHEN outcome = 'error' THEN 'error' WHEN outcome IN ('nothing', 'down') THEN 'nothing' WHEN truth IS NULL THEN 'by eye'
 WHEN outcome = 'confident' THEN CASE WHEN coalesce(top = truth, false) THEN 'right' ELSE 'wrong' END ELSE CASE WHEN coalesce(top = truth, false) THEN 'not sure (right top)' ELSE 'not sure (wrong top)' END END AS verdict, count(*) AS n FROM o GROUP BY 1""",
    "rescue_answers": f"""WITH {_IDX}, m AS (SELECT query_id, entity_id, max(score) AS score FROM lists WHERE entity_id <> {_ASIDE} GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS n, round(score - coalesce(lead(score) OVER w, 0), 6) AS "lead" FROM m WINDOW w AS (PARTITION BY query_id ORDER BY score DESC))
SELECT a.query_id, entity_id, score, "lead", coalesce(score >= {_FLOOR} AND "lead" >= {_LEAD}, false) AS answered FROM (SELECT DISTINCT query_id FROM lists) a LEFT JOIN n ON n.query_id = a.query_id AND n = 1""",
}
