"""Queries of sequential rules and box columns, on boxes made from vectors and on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.operators import assignment as A
from entrack.operators import geometry as G
from entrack.plans.sequences import events
from entrack.plans.spatial import _B, _inter, _iou, boxes
from entrack.sources.tables import table


def quads(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes with turned corners, a kind, a session and a frame of about ten boxes."""
    b = boxes(spark, sf)
    turned = G.corners(F.col("x") / 4, F.col("y") / 4, F.col("w"), F.col("h"), F.col("conf") * 45)
    kind = F.when(F.col("box_id") % 5 == 0, "down").otherwise("up")
    n = F.row_number().over(Window.partitionBy("frame").orderBy("box_id")) - 1
    return b.withColumn("quad", turned).withColumn("kind", kind).withColumn("session", F.col("frame")).withColumn("frame", F.floor(n / 10))


def row_order(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("mid", F.col("y") + F.col("h") / 2)
    return A.by_group(b.select("frame", "box_id", "x", "y", "w", "h", "mid"), ["frame"], ["mid", "box_id"], A.reading_order, "frame long, box_id long, place long")


def frame_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Even boxes are labels, odd ones detections: outcomes and corner errors."""
    q = quads(spark, sf)
    label = F.col("box_id") % 2 == 0
    kind = F.when(label & (F.col("box_id") % 14 == 0), "ignore").otherwise(F.col("kind"))
    rows = q.select("session", "box_id", label.alias("is_label"), kind.alias("kind"), "conf", "quad")
    return A.by_group(rows, ["session"], ["box_id"], A.scored_frame(0.4), "session long, label_id long, box_id long, outcome string, px double, relative double")


def frame_score_totals(spark: SparkSession, sf: str) -> DataFrame:
    return frame_scores(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("px"), 4).alias("px"), F.round(F.avg("relative"), 4).alias("relative"))


def batch_tracks(spark: SparkSession, sf: str) -> DataFrame:
    rows = quads(spark, sf).select("session", "frame", "box_id", "kind", "quad")
    return A.by_group(rows, ["session"], ["frame", "box_id"], A.batch_tracks(0.5), "session long, frame long, box_id long, track long")


def cross_frame_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = quads(spark, sf).select("session", "frame", "box_id", "quad", (-F.col("conf")).alias("dark"))
    return A.by_group(rows, ["session"], ["dark", "box_id"], A.deduped(0.5), "session long, box_id long, frame long")


def tile_merge(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).where("conf >= 0.3").withColumn("cut", F.col("box_id") % 4 == 0)
    rule = lambda rows: A.merged_tiles(rows, 0.5, 0.7)
    return A.by_group(b.select("frame", "box_id", "cut", "conf", "x", "y", "w", "h"), ["frame"], ["box_id"], rule, "frame long, box_id long, place long")


def label_by_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each odd box takes the label of the even box it overlaps most, from a half on."""
    q = quads(spark, sf).withColumn("o", G.bounds(F.col("quad")))
    part = lambda d, p, *more: d.select("session", F.col("box_id").alias(f"{p}_id"), *more, F.flatten("quad").alias(f"{p}_quad"), *[F.col(f"o.{c}").alias(f"{p}{c}") for c in "xywh"])
    a, b = part(q.where("box_id % 2 = 1"), "a"), part(q.where("box_id % 2 = 0"), "b", F.col("kind").alias("label"))
    got = G.outlines_sharing(a, b, "a", "b", 0.5, 100.0, ["session"], kept=["session", "a_id", "b_id", "label"], best=True)
    return got.groupBy("session", "a_id").agg(F.max_by(F.struct("label", "b_id", "quad_iou"), F.struct("quad_iou", -F.col("b_id"))).alias("m")).select("session", "a_id", "m.*")


def reread_votes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("user_id", F.col("event_id").alias("seq"), (F.col("k") < 15).alias("moved"), F.when(F.col("k") >= 40, (F.col("k") % 3).cast("double")).alias("entity_id"))
    return A.by_group(e, ["user_id"], ["seq"], A.rereads, "user_id long, seq long, reads long, before double")


def listed_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    rows = e.select("user_id", F.col("event_id").alias("seq"), "at", (F.col("k") > 30).alias("over"), (F.col("event_type") == "view").alias("quiet"), (F.col("k") > 80).alias("found"))
    return A.by_group(rows, ["user_id"], ["at", "seq"], A.checks(3, 10_000.0), "user_id long, seq long, due boolean")


def staged_hits(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.col("k").alias("key"), (F.col("event_type") != "view").alias("put"))
    return A.by_group(e, ["user_id"], ["seq"], A.staged(20), "user_id long, seq long, found boolean")


def _point(quad: Column, i: int, axis: int) -> Column:
    return F.get(F.get(quad, i), axis)


def mean_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The upright box that a quad is on average: middle, sides, and the angle of its short side."""
    q = quads(spark, sf)
    p = [[_point(F.col("quad"), i, axis) for axis in (0, 1)] for i in range(4)]
    gap = lambda a, b: F.hypot(p[b][0] - p[a][0], p[b][1] - p[a][1])
    w, h = (gap(0, 1) + gap(3, 2)) / 2, (gap(0, 3) + gap(1, 2)) / 2
    angle = F.atan2(p[1][1] - p[0][1] + p[2][1] - p[3][1], p[1][0] - p[0][0] + p[2][0] - p[3][0])
    middle = [F.round((p[0][axis] + p[1][axis] + p[2][axis] + p[3][axis]) / 4, 6) for axis in (0, 1)]
    got = q.select("box_id", middle[0].alias("cx"), middle[1].alias("cy"), F.round(F.least(w, h), 6).alias("w"), F.round(F.greatest(w, h), 6).alias("h"), F.when(F.round(w - h, 9) > 0, angle + F.lit(3.141592653589793) / 2).otherwise(angle).alias("a"))
    return got.select("box_id", "cx", "cy", "w", "h", F.round("a", 6).alias("angle"))


def screen_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a video frame on the screen that shows it: 640 x 480 in a box at (100, 50) of a shot twice as wide."""
    b = boxes(spark, sf)
    s, fx, fy, fw, fh, kx0, ky0 = 2.0, 100.0, 50.0, 960.0, 600.0, 640.0, 480.0
    kx, ky = fw / kx0 * s, fh / ky0 * s
    k = (kx * ky) ** 0.5
    return b.select("box_id", F.round(fx * s + F.col("x") * kx, 6).alias("cx"), F.round(fy * s + F.col("y") * ky, 6).alias("cy"), F.round(F.col("w") * k, 6).alias("w"), F.round(F.col("h") * k, 6).alias("h"))


def reached_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of a 500 x 400 image where a selection has no room around it, and those that a box comes near."""
    b, width, height, margin, slack = boxes(spark, sf), 500.0, 400.0, 0.25, 0.5
    x, y, w, h = (F.col(c) for c in "xywh")
    ix, iy = F.pmod(x, F.lit(200.0)), F.pmod(y, F.lit(200.0))
    room = {"left": (ix, w), "top": (iy, w), "right": (width - ix - w, w), "bottom": (height - iy - h, w)}
    near = {"left": ix, "top": iy, "right": width - ix - w, "bottom": height - iy - h}
    short = F.array_compact(F.array(*[F.when(have < margin * want - slack, F.lit(side)) for side, (have, want) in room.items()]))
    close = F.array_compact(F.array(*[F.when((have < margin * want - slack) & (near[side] <= 8), F.lit(side)) for side, (have, want) in room.items()]))
    return b.select("box_id", F.array_join(short, ",").alias("short"), F.array_join(close, ",").alias("reached"))


def covered_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Weak boxes that fit a user's box much better than the picked one does, the smallest id of each user."""
    b = boxes(spark, sf)
    part = lambda d, p, key: d.select(F.col("frame"), F.col("box_id").alias(key), *[F.col(c).alias(p + c) for c in "xywh"])
    pick = part(b.where("conf >= 0.5"), "p", "pick_id")
    user = b.select("frame", F.col("box_id").alias("pick_id"), (F.col("x") - 15).alias("ux"), (F.col("y") - 15).alias("uy"), (F.col("w") * 0.8).alias("uw"), (F.col("h") * 0.8).alias("uh"))
    both = pick.join(user, ["frame", "pick_id"]).withColumn("fit", F.round(G.iou("p", "u"), 9))
    met = G.overlapping(both, part(b.where("conf < 0.5"), "k", "weak_id"), "u", "k", 0.1, 100.0, ["frame"])
    good = (F.round(F.col("iou") - F.col("fit"), 9) >= 0.02) & (F.round(G.inside_share("p", "k"), 9) <= 0.8)
    return met.where(good).groupBy("pick_id").agg(F.min("weak_id").alias("weak_id"))


def box_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """How an item may lie in a box: its shape, the ways to fit it, and the largest fitting rectangle of the first."""
    b, aspect = boxes(spark, sf), 0.686
    shape = F.when(F.abs(F.col("w") / F.col("h") - aspect) <= 0.1, "portrait").when(F.abs(F.col("h") / F.col("w") - aspect) <= 0.1, "landscape").otherwise("other")
    ratio = F.col("w") / F.col("h")
    ways = F.when(ratio < 0.9, "portrait").when(ratio > 1.1, "landscape").otherwise("portrait,landscape")
    fit = F.when(ways.startswith("portrait"), F.least(F.col("w"), F.col("h") * aspect)).otherwise(F.least(F.col("w"), F.col("h") / aspect))
    return b.select("box_id", shape.alias("shape"), ways.alias("ways"), F.round(fit, 6).alias("fit_w"))


def tilt_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of tilts and the quarter turns that bring a direction upright."""
    b = boxes(spark, sf)
    turn = F.pmod(F.floor(F.col("conf") * 700 / 90 + 0.5), F.lit(4))
    return b.select("box_id", F.round(G.tilt_apart(F.col("conf") * 360, F.col("x") / 10), 6).alias("apart"), turn.alias("turns"))


def board_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The largest box that holds each point, else the whole view, and on which side of its middle the point is."""
    b = boxes(spark, sf)
    points = b.select(F.col("box_id").alias("point_id"), (F.col("x") + 5).alias("px"), (F.col("y") + 5).alias("py"))
    frames = b.where("conf >= 0.5").select("box_id", "x", "y", "w", "h")
    first = G.first_boxes(points, frames, 200.0, lambda r: (-r["w"] * r["h"],), more=("y", "h"))
    found = points.join(first, "point_id", "left")
    middle = F.coalesce(F.col("y") + F.col("h") / 2, F.lit(500.0))
    return found.select("point_id", F.col("box_id").alias("frame_id"), F.when(F.col("py") > middle, "near").otherwise("far").alias("side"))


def fresh_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes to read in each frame: none that a known box covers, the pointed one first, then the larger, eight at most."""
    b = boxes(spark, sf)
    part = lambda d, p, key: d.select("frame", F.col("box_id").alias(key), *[F.col(c).alias(p + c) for c in "xywh"])
    known = G.overlapping(part(b, "a", "box_id"), part(b.where("box_id % 9 = 0"), "k", "known_id"), "a", "k", 0.3, 200.0, ["frame"]).select("frame", "box_id").distinct()
    rest = b.join(known, ["frame", "box_id"], "left_anti")
    pointed = F.lit(500.0).between(F.col("x"), F.col("x") + F.col("w")) & F.lit(500.0).between(F.col("y"), F.col("y") + F.col("h"))
    w = Window.partitionBy("frame").orderBy(pointed.cast("int").desc(), (F.col("w") * F.col("h")).desc(), "box_id")
    return rest.withColumn("place", F.row_number().over(w)).where("place <= 8").select("frame", "place", "box_id")


def cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Items that wait after a failure: an hour for most, ten minutes where the host was busy, a week where it is gone."""
    e = events(spark, sf)
    wait = F.when(F.col("event_type") == "error", 7 * 86400.0).when(F.col("event_type") == "click", 600.0).otherwise(3600.0)
    waiting = e.where(F.lit(1704067200.0 + 86400 * 25) - F.col("at") < wait)
    return waiting.groupBy("user_id").agg(F.max(F.col("at") + wait).alias("until")).select("user_id", F.round("until", 3).alias("until"))


_SEQUENTIAL = (row_order, frame_scores, frame_score_totals, batch_tracks, cross_frame_dedupe, tile_merge, label_by_overlap, reread_votes, listed_checks, staged_hits)
_COLUMNS = (mean_boxes, screen_boxes, reached_sides, covered_pick, box_hypotheses, tilt_turns, board_sides, fresh_reads, cooldowns)
QUERIES = {f.__name__: f for f in (*_SEQUENTIAL, *_COLUMNS)}

_AREA = "{0}.w * {0}.h"
ORACLES = {
    "mean_boxes": f"""WITH {_B} SELECT box_id, round(x / 4, 6) AS cx, round(y / 4, 6) AS cy, round(least(w, h), 6) AS w, round(greatest(w, h), 6) AS h,
round(CASE WHEN w > h THEN radians(conf * 45) + pi() / 2 ELSE radians(conf * 45) END, 6) AS angle FROM b""",
    "screen_boxes": f"WITH {_B} SELECT box_id, round(200 + x * 3.0, 6) AS cx, round(100 + y * 2.5, 6) AS cy, round(w * sqrt(7.5::DOUBLE), 6) AS w, round(h * sqrt(7.5::DOUBLE), 6) AS h FROM b",
    "reached_sides": f"""WITH {_B}, m AS (SELECT *, x - 200 * floor(x / 200) AS ix, y - 200 * floor(y / 200) AS iy, 0.25 * w - 0.5 AS need FROM b), s AS (SELECT *, 500 - ix - w AS r, 400 - iy - h AS d FROM m)
SELECT box_id, array_to_string(list_filter([CASE WHEN ix < need THEN 'left' END, CASE WHEN iy < need THEN 'top' END, CASE WHEN r < need THEN 'right' END, CASE WHEN d < need THEN 'bottom' END], lambda z: z IS NOT NULL), ',') AS short,
array_to_string(list_filter([CASE WHEN ix < need AND ix <= 8 THEN 'left' END, CASE WHEN iy < need AND iy <= 8 THEN 'top' END, CASE WHEN r < need AND r <= 8 THEN 'right' END, CASE WHEN d < need AND d <= 8 THEN 'bottom' END], lambda z: z IS NOT NULL), ',') AS reached FROM s""",
    "covered_pick": f"""WITH {_B}, u AS (SELECT box_id, frame, x - 15 AS x, y - 15 AS y, w * 0.8::DOUBLE AS w, h * 0.8::DOUBLE AS h FROM b)
SELECT p.box_id AS pick_id, min(k.box_id) AS weak_id FROM b p JOIN u ON u.box_id = p.box_id JOIN b k ON k.frame = p.frame AND k.conf < 0.5 WHERE p.conf >= 0.5 AND {_inter("u", "k")} > 0 AND {_iou("u", "k")} >= 0.1
AND round({_iou("u", "k")} - {_iou("p", "u")}, 9) >= 0.02 AND round({_inter("p", "k")} / (p.w * p.h), 9) <= 0.8 GROUP BY 1""",
    "box_hypotheses": f"""WITH {_B} SELECT box_id, CASE WHEN abs(w / h - 0.686::DOUBLE) <= 0.1 THEN 'portrait' WHEN abs(h / w - 0.686::DOUBLE) <= 0.1 THEN 'landscape' ELSE 'other' END AS shape,
CASE WHEN w / h < 0.9::DOUBLE THEN 'portrait' WHEN w / h > 1.1::DOUBLE THEN 'landscape' ELSE 'portrait,landscape' END AS ways, round(CASE WHEN w / h > 1.1::DOUBLE THEN least(w, h / 0.686::DOUBLE) ELSE least(w, h * 0.686::DOUBLE) END, 6) AS fit_w FROM b""",
    "tilt_turns": f"WITH {_B}, d AS (SELECT box_id, conf, (conf * 360 - x / 10) - 180 * floor((conf * 360 - x / 10) / 180) AS d FROM b) SELECT box_id, round(least(d, 180 - d), 6) AS apart, CAST(floor(conf * 700 / 90 + 0.5) AS BIGINT) % 4 AS turns FROM d",
    "board_sides": f"""WITH {_B}, h AS (SELECT p.box_id AS point_id, p.y + 5 AS py, q.box_id AS frame_id, q.y + q.h / 2 AS mid, row_number() OVER (PARTITION BY p.box_id ORDER BY q.w * q.h DESC, q.box_id) AS n
FROM b p LEFT JOIN b q ON q.conf >= 0.5 AND p.x + 5 BETWEEN q.x AND q.x + q.w AND p.y + 5 BETWEEN q.y AND q.y + q.h) SELECT point_id, frame_id, CASE WHEN py > coalesce(mid, 500) THEN 'near' ELSE 'far' END AS side FROM h WHERE n = 1""",
    "fresh_reads": f"""WITH {_B}, r AS (SELECT * FROM b p WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.frame = p.frame AND k.box_id % 9 = 0 AND {_inter("p", "k")} > 0 AND {_iou("p", "k")} >= 0.3))
SELECT frame, CAST(place AS INTEGER) AS place, box_id FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (500 BETWEEN x AND x + w AND 500 BETWEEN y AND y + h)::INT DESC, w * h DESC, box_id) AS place FROM r) WHERE place <= 8""",
    "cooldowns": """WITH e AS (SELECT user_id, round(epoch_us(ts) / 1e6, 6) AS tm, CASE event_type WHEN 'error' THEN 604800 WHEN 'click' THEN 600 ELSE 3600 END AS wait FROM events)
SELECT user_id, round(max(tm + wait), 3) AS until FROM e WHERE 1704067200.0::DOUBLE + 86400 * 25 - tm < wait GROUP BY 1""",
}
