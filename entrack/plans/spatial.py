"""Queries on boxes made from vectors: position and size from the first components, frames from the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.operators import geometry as G
from entrack.operators import graph
from entrack.operators import vectors as V
from entrack.sources.tables import table

CELL = 200.0


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """box_id, x, y, w, h, conf, frame: whole numbers, about a thousand wide."""
    e = table(spark, sf, "embeddings")
    whole = lambda i, k: F.floor((F.get("embedding", F.lit(i)).cast("double") + 0.5) * k + 0.5).cast("double")
    return e.select(
        F.col("vec_id").alias("box_id"), whole(0, 2000).alias("x"), whole(1, 2000).alias("y"), F.greatest(F.lit(20.0), whole(2, 200)).alias("w"), F.greatest(F.lit(20.0), whole(3, 200)).alias("h"),
        (whole(4, 1000) / 1000).alias("conf"), F.col("label").cast("long").alias("frame"),
    )


def _as(d: DataFrame, prefix: str, keys: dict[str, str]) -> DataFrame:
    return d.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(prefix + c) for c in "xywh"])


def box_iou_join(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    return G.overlapping(_as(b, "a", {"box_id": "a_id"}), _as(b, "b", {"box_id": "b_id"}), "a", "b", 0.3, CELL, ordered=("a_id", "b_id"), kept=["a_id", "b_id"])


def box_shapes(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).withColumn("quad", G.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("conf") * 90))
    o = G.bounds(F.col("quad"))
    return b.select(
        "box_id", F.round(G.area(F.col("quad")), 3).alias("area"), F.round(o["w"], 6).alias("bound_w"), F.round(o["h"], 6).alias("bound_h"),
        G.holds_point(F.col("quad"), F.col("x") + 30, F.col("y") + 1).alias("holds"), F.round(G.tilt_apart(F.col("conf") * 360, F.lit(10)), 6).alias("tilt"),
    )


def point_in_box(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    points = b.select(F.col("box_id").alias("point_id"), (F.col("x") + 15).alias("px"), (F.col("y") + 15).alias("py"))
    return G.boxes_at(points, b.select("box_id", "x", "y", "w", "h"), CELL)


def pick_box(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    users = b.select(F.col("box_id").alias("user_id"), (F.col("x") - 20).alias("ux"), (F.col("y") - 20).alias("uy"), (F.col("w") + 30).alias("uw"), (F.col("h") + 30).alias("uh"))
    return G.picked(b.select("box_id", "conf", *[F.col(c).alias(f"b{c}") for c in "xywh"]), users, 0.5, CELL)


def merge_detections(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    got = G.without_centre_matches(b.where("conf >= 0.5").select("box_id", "x", "y", "w", "h"), b.where("conf < 0.5").select("box_id", "x", "y", "w", "h"), CELL)
    return got.select("box_id", "origin")


def overlay_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes seen at the same place in at least two other frames."""
    b = boxes(spark, sf)
    met = G.seen_in_frames(_as(b, "a", {"box_id": "a_id", "frame": "af"}), _as(b, "b", {"box_id": "b_id", "frame": "bf"}), "a", "b", 0.2, CELL, 2)
    return met.groupBy("a_id").agg(F.count_distinct("bf").alias("frames")).where("frames >= 2")


def nms(spark: SparkSession, sf: str) -> DataFrame:
    return G.suppressed(boxes(spark, sf), ["frame"], 0.1, CELL).select("frame", "box_id", "conf")


def nms_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression by the overlap of turned outlines, which is less than that of their bounds."""
    turned = boxes(spark, sf).withColumn("quad", G.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("conf") * 45)).withColumn("o", G.bounds(F.col("quad")))
    return G.suppressed(turned.select("frame", "box_id", "conf", "quad", "o.*"), ["frame"], 0.1, CELL, "quad").select("frame", "box_id", "conf")


def greedy_cover(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches between strong and weak boxes, best overlap first."""
    b = boxes(spark, sf)
    return G.greedy_overlaps(_as(b.where("conf >= 0.5"), "a", {"box_id": "a_id"}), _as(b.where("conf < 0.5"), "b", {"box_id": "b_id"}), "a", "b", "a_id", "b_id", 0.05, CELL)


def quad_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of turned boxes whose bounds meet."""
    b = boxes(spark, sf)
    quads = b.withColumn("quad", G.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("conf") * 45)).withColumn("o", G.bounds(F.col("quad")))
    a, c = (quads.select(F.col("box_id").alias(f"{p}_id"), F.flatten("quad").alias(f"{p}_quad"), *[F.col(f"o.{c}").alias(f"{p}{c}") for c in "xywh"]) for p in "ab")
    return G.outlines_sharing(a, c, "a", "b", 0.3, CELL, ordered=("a_id", "b_id"), kept=["a_id", "b_id"])


def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 100 + 640).alias("length"))
    return p.select("p_partkey", F.explode(G.tiles(F.col("length"), 640, 512)).alias("at")).withColumn("at", F.col("at").cast("long"))


def read_order(spark: SparkSession, sf: str) -> DataFrame:
    """Eight boxes of each frame: the weakest read first, then the larger."""
    w = Window.partitionBy("frame").orderBy(F.floor(F.col("conf") * 4), (F.col("w") * F.col("h")).desc(), "box_id")
    return boxes(spark, sf).withColumn("place", F.row_number().over(w)).where("place <= 8").select("frame", "place", "box_id")


def similarity_components(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of linked boxes: overlap of a tenth or more."""
    b = boxes(spark, sf)
    met = G.overlap_links(_as(b, "a", {"box_id": "a_id"}), _as(b, "b", {"box_id": "b_id"}), "a", "b", "a_id", "b_id", 0.1, CELL)
    got = graph.groups(b.select(F.col("box_id").alias("node")), met)
    return got.groupBy("group_id").agg(F.count("*").alias("n"), F.max("node").alias("largest"))


_B = """e AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
b AS (SELECT vec_id AS box_id, floor((v[1] + 0.5) * 2000 + 0.5) AS x, floor((v[2] + 0.5) * 2000 + 0.5) AS y, greatest(20.0, floor((v[3] + 0.5) * 200 + 0.5)) AS w, greatest(20.0, floor((v[4] + 0.5) * 200 + 0.5)) AS h,
  floor((v[5] + 0.5) * 1000 + 0.5) / 1000 AS conf, CAST(label AS BIGINT) AS frame FROM e)"""


def _inter(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def _iou(a: str, b: str) -> str:
    return f"round({_inter(a, b)} / ({a}.w * {a}.h + {b}.w * {b}.h - {_inter(a, b)}), 9)"


_MID = "{0}.x + {0}.w / 2 BETWEEN {1}.x AND {1}.x + {1}.w AND {0}.y + {0}.h / 2 BETWEEN {1}.y AND {1}.y + {1}.h"
_ALL = (box_iou_join, box_shapes, point_in_box, pick_box, merge_detections, overlay_filter, nms, nms_outlines, greedy_cover, quad_overlap, tile_plan, read_order, similarity_components)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "box_iou_join": f"WITH {_B} SELECT p.box_id AS a_id, q.box_id AS b_id, {_iou('p', 'q')} AS iou FROM b p JOIN b q ON p.box_id < q.box_id WHERE {_iou('p', 'q')} >= 0.3",
    "box_shapes": f"""WITH {_B}, c AS (SELECT *, cos(radians(conf * 90)) AS c, sin(radians(conf * 90)) AS s FROM b),
q AS (SELECT *, (30 * c + 1 * s) AS u, (-30 * s + 1 * c) AS v, conf * 360 - 10 - 180 * floor((conf * 360 - 10) / 180) AS d FROM c)
SELECT box_id, round(w * h, 3) AS area, round(w * abs(c) + h * abs(s), 6) AS bound_w, round(w * abs(s) + h * abs(c), 6) AS bound_h, abs(u) < w / 2 AND abs(v) < h / 2 AS holds, round(least(d, 180 - d), 6) AS tilt FROM q""",
    "point_in_box": f"""WITH {_B} SELECT p.box_id AS point_id, q.box_id FROM b p JOIN b q ON p.x + 15 BETWEEN q.x AND q.x + q.w AND p.y + 15 BETWEEN q.y AND q.y + q.h
QUALIFY row_number() OVER (PARTITION BY p.box_id ORDER BY round(q.w * q.h, 9), round(power(q.x + q.w / 2 - p.x - 15, 2) + power(q.y + q.h / 2 - p.y - 15, 2), 9), q.box_id) = 1""",
    "pick_box": f"""WITH {_B}, u AS (SELECT box_id AS user_id, x - 20 AS x, y - 20 AS y, w + 30 AS w, h + 30 AS h FROM b),
whole AS (SELECT * FROM b p WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.box_id <> p.box_id AND o.w * o.h > p.w * p.h AND round({_inter("p", "o")} / (p.w * p.h), 9) >= 0.9)),
m AS (SELECT u.user_id, p.box_id, p.conf, round({_inter("p", "u")} / (p.w * p.h), 9) AS inside, round(power(p.x + p.w / 2 - u.x - u.w / 2, 2) + power(p.y + p.h / 2 - u.y - u.h / 2, 2), 9) AS far
  FROM u JOIN whole p ON {_inter("p", "u")} > 0 WHERE round({_inter("p", "u")} / (p.w * p.h), 9) >= 0.5 OR {_iou("p", "u")} >= 0.5),
t AS (SELECT *, max(inside) OVER (PARTITION BY user_id) AS most FROM m)
SELECT user_id, box_id, inside FROM t WHERE round(most - inside, 9) <= 0.1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY far, conf DESC, box_id) = 1""",
    "merge_detections": f"""WITH {_B} SELECT box_id, 'base' AS origin FROM b WHERE conf >= 0.5 UNION ALL SELECT box_id, 'extra' FROM b p WHERE conf < 0.5 AND NOT EXISTS (
  SELECT 1 FROM b o WHERE o.conf >= 0.5 AND {_inter("p", "o")} > 0 AND (({_MID.format("p", "o")}) OR ({_MID.format("o", "p")})))""",
    "overlay_filter": f"WITH {_B} SELECT p.box_id AS a_id, count(DISTINCT q.frame) AS frames FROM b p JOIN b q ON abs(p.frame - q.frame) >= 2 AND {_inter('p', 'q')} > 0 AND {_iou('p', 'q')} >= 0.2 GROUP BY 1 HAVING count(DISTINCT q.frame) >= 2",
    "tile_plan": "WITH p AS (SELECT p_partkey, p_size * 100 AS last FROM part), t AS (SELECT p_partkey, last, unnest(range(0, CAST(ceil(last / 512) AS BIGINT) + 1)) AS i FROM p) SELECT DISTINCT p_partkey, CAST(least(i * 512, last) AS BIGINT) AS \"at\" FROM t",
    "read_order": f"WITH {_B} SELECT frame, CAST(place AS INTEGER) AS place, box_id FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY floor(conf * 4), w * h DESC, box_id) AS place FROM b) WHERE place <= 8",
    "similarity_components": f"""WITH RECURSIVE {_B}, l AS (SELECT p.box_id AS s, q.box_id AS t FROM b p JOIN b q ON p.box_id <> q.box_id AND {_inter("p", "q")} > 0 WHERE {_iou("p", "q")} >= 0.1),
r AS (SELECT box_id AS node, box_id AS other FROM b UNION SELECT r.node, l.t FROM r JOIN l ON r.other = l.s), g AS (SELECT node, min(other) AS group_id FROM r GROUP BY node)
SELECT group_id, count(*) AS n, max(node) AS largest FROM g GROUP BY 1""",
}


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of boxes over time: ids in order make frames of ten boxes, the label is the session."""
    from entrack.streaming.processors import tracked

    b = boxes(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("frame").orderBy("box_id")) - 1)
    frames = b.groupBy(F.col("frame").alias("session"), F.floor(F.col("n") / 10).alias("frame")).agg(F.sort_array(F.collect_list(F.struct(F.col("box_id").alias("id"), "x", "y", "w", "h"))).alias("boxes"))
    return tracked(frames)


QUERIES["tracks"] = tracks
