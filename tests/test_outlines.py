"""Outlines, parts of selections, verdicts, rescues and followed tracks against plain versions and planted cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from test_assignment import plain_iou, streamed

from entrack.operators import outlines as O  # noqa: E741
from entrack.operators import ranking as R
from entrack.plans import outlines as plans
from entrack.plans.spatial import boxes
from entrack.streaming import processors

OUTLINES = "box_id long, quad array<array<double>>"


def ring(x: float, y: float, w: float, h: float, degrees: float) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[x + a * w * c - b * h * s, y + a * w * s + b * h * c] for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]


def plain_tilt(q: list) -> float:
    length = lambda a, b: math.dist(q[a], q[b])
    angle = math.degrees(math.atan2(q[1][1] - q[0][1] + q[2][1] - q[3][1], q[1][0] - q[0][0] + q[2][0] - q[3][0]))
    return angle + 90 * (round(length(0, 1) + length(3, 2) - length(0, 3) - length(1, 2), 9) > 0)


def inside(q: list, x: float, y: float) -> bool:
    turns = [round((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]), 9) for a, b in zip(q, [*q[1:], q[0]], strict=True)]
    return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)


def plain_click(quad: list, x: float, y: float, found: list[tuple]) -> int | None:
    """``found``: (place, box_id, kind, quad)."""
    near = []
    for _, box_id, kind, q in sorted(found, key=lambda f: f[:2]):
        if kind == "up" and round(plain_iou(q, quad), 9) >= 0.5:
            d = (plain_tilt(q) - plain_tilt(quad)) % 180
            near.append((box_id, round(min(d, 180 - d), 9) > 20, inside(q, x, y)))
    if any(not apart for _, apart, _ in near):
        return None
    return next((box_id for box_id, _, held in near if held), None)


def test_clicks_by_looking_at_each(spark, small):
    wanted = {}
    for b in boxes(spark, small).collect():
        angle, k = b.conf * 45, b.box_id
        ways = [(0, 35.0, 2.0, 1.0, 1.0), (1, -28.0, -4.0, 3.0, 1.1), (2, 4.0, 12.0, -9.0, 0.9), (3, 60.0, 40.0, 30.0, 1.0)]
        found = [((k * 7 + n * 5) % 11, k * 4 + n, "down" if (k + n * 2) % 3 == 0 else "up", ring(b.x + dx, b.y + dy, b.w * g, b.h * g, angle + t)) for n, t, dx, dy, g in ways]
        at = (b.x + 2, b.y + 2) if k % 2 == 0 else (b.x, b.y)
        wanted[k] = plain_click(ring(b.x, b.y, b.w, b.h, angle), *at, found)
    assert {r.click_id: r.box_id for r in plans.click_redetect(spark, small).collect()} == wanted
    assert 20 < sum(v is not None for v in wanted.values()) < len(wanted) - 20


def test_clicks_on_odd_outlines(spark):
    square = ring(50, 50, 20, 30, 0)
    clicks = spark.createDataFrame([(1, square, None, None), (2, square[:3], None, None), (3, None, 5.0, 5.0), (4, square, 90.0, 90.0), (5, square, None, None)], "k long, quad array<array<double>>, px double, py double")
    turned, alike = ring(50, 50, 20, 30, 30), ring(51, 50, 20, 30, 0)
    found = [(1, 11, 2, "up", turned), (1, 12, 2, "up", turned), (1, 13, 1, "down", turned), (1, 14, 0, "up", square[:2]), (2, 21, 0, "up", turned), (3, 31, 0, "up", turned), (4, 41, 0, "up", turned), (5, 51, 0, "up", turned), (5, 52, 9, "up", alike), (9, 91, 0, "up", turned)]
    found = spark.createDataFrame(found, "k long, box_id long, place int, kind string, quad array<array<double>>")
    assert {r.k: r.box_id for r in O.redetected(clicks, found, "k").collect()} == {1: 11, 2: None, 3: None, 4: None, 5: None}
    assert {r.k: r.box_id for r in O.redetected(clicks, found.limit(0), "k").collect()} == dict.fromkeys(range(1, 6))
    assert O.redetected(clicks.limit(0), found, "k").count() == 0


def test_corners_in_any_order_come_back_the_same(spark):
    straight = ring(10, 20, 6, 9, 33)
    ways = [straight[k:] + straight[:k] for k in range(4)]
    ways += [w[::-1] for w in ways]
    rows = spark.createDataFrame(list(enumerate(ways)), OUTLINES)
    rows = rows.withColumn("other", F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in ring(10.5, 20, 6, 9, 30)]))
    ordered = rows.withColumn("quad", O.clockwise(F.col("quad"))).withColumn("quad", O.from_short_side(F.col("quad")))
    for r in ordered.collect():
        assert r.quad in (straight, straight[2:] + straight[:2])
    assert all(r.q == straight for r in ordered.select(O.aligned(F.col("quad"), F.col("other")).alias("q")).collect())
    turns = spark.createDataFrame([(d, ring(0, 0, 4, 8, d)) for d in (0, 44, 46, 90, 180, 270, -30)], OUTLINES)
    assert {r.box_id: r.t for r in turns.select("box_id", O.quarter_turns(F.col("quad")).alias("t")).collect()} == {0: 0, 44: 0, 46: 270, 90: 270, 180: 180, 270: 90, -30: 0}
    points = spark.createDataFrame([(10.0, 20.0), (*straight[1],), (30.0, 30.0)], "x double, y double").withColumn("q", F.array(*[F.array(*[F.lit(v) for v in p]) for p in straight]))
    assert [r.h for r in points.select(O.holds(F.col("q"), F.col("x"), F.col("y")).alias("h")).collect()] == [True, True, False]


def test_sides_without_a_usable_box_are_none(spark):
    odd = [(None, 0.0, 10.0, 10.0), (float("nan"), 0.0, 10.0, 10.0), (0.0, float("inf"), 10.0, 10.0), (0.0, 0.0, 0.5, 10.0), (0.0, 9.0, 100.0, 100.0)]
    rows = spark.createDataFrame(odd, "x double, y double, w double, h double")
    sides = [r.s for r in rows.select(O.short_sides(F.lit(110.0), F.lit(110.0), [F.col(c) for c in "xywh"]).alias("s")).collect()]
    assert sides == [[], [], [], [], ["left", "bottom"]]


CROPS = "k long, width int, height int, inner struct<x: double, y: double, w: double, h: double>, views array<struct<w: double, h: double>>, art_too boolean, box_too boolean"


def test_parts_of_planted_selections(spark):
    nan = float("nan")
    rows = [
        (1, 59, 86, (0.0, 0.0, 59.0, 86.0), None, None, None),
        (2, 59, 86, (0.0, 0.0, 59.0, 86.0), None, False, None),
        (3, 86, 59, (0.0, 0.0, 86.0, 59.0), [(590.0, 860.0)], True, True),
        (4, 86, 59, (0.0, 0.0, 86.0, 59.0), [(590.0, 860.0), (0.0, 5.0)], True, False),
        (5, 100, 100, (nan, 0.0, 5.0, 5.0), [], True, False),
        (6, 100, 200, None, None, True, True),
        (7, 0, 200, None, None, True, True),
        (8, 1, 1, None, None, True, True),
    ]
    found: dict[int, list] = {}
    for r in O.crops(spark.createDataFrame(rows, CROPS), "k").orderBy("k", "place").collect():
        found.setdefault(r.k, []).append((r.part, r.turn, r.x, r.y, r.w, r.h))
    names = {k: [(p, t) for p, t, *_ in parts] for k, parts in found.items()}
    assert names[1] == [("whole", 0), ("whole", 180), ("square", 0), ("square", 180)]
    assert names[2] == [("whole", 0), ("whole", 180)]
    assert names[3] == [("item", 0), ("item", 180), ("whole", 90), ("whole", 270)]
    assert names[4] == [("item", 0), ("item", 180)]
    assert names[5] == [("fit", 0), ("fit", 180), ("fit", 90), ("fit", 270), ("square", 0), ("square", 180)]
    assert names[6] == [("fit", 0), ("fit", 180), ("square", 0), ("square", 180)]
    assert 7 not in names and all(w >= 1 and h >= 1 and 0 <= x < 1 and 0 <= y < 1 for _, _, x, y, w, h in found[8])
    # the art of an upright item: 0.118 and 0.181 of 59 and 86 from its corner, 0.765 and 0.525 of them wide and high
    assert found[1][0][2:] == (7, 16, 45, 45) and found[1][1][2:] == (59 - 7 - 45, 86 - 16 - 45, 45, 45)
    # turned clockwise, the item's top is the view's left side
    assert found[3][2][2:] == (16, 59 - 7 - 45, 45, 45) and found[3][3][2:] == (86 - 16 - 45, 7, 45, 45)
    assert found[5][4][2:] == found[5][5][2:] == (4, 4, 92, 92)
    assert O.crops(spark.createDataFrame([], CROPS), "k").count() == 0


def test_rescue_looks_past_the_sentinel(spark):
    rows = [(1, 0, 1, -1, 0, 0.9), (1, 0, 2, 5, 1, 0.8), (1, 1, 1, 6, 2, 0.77), (2, 0, 1, 5, 1, 0.8), (2, 0, 2, 6, 1, 0.78), (3, 0, 1, -1, 0, 0.9), (4, 0, 1, 5, 1, 0.71), (5, 1, 1, 5, 1, 0.72)]
    lists = spark.createDataFrame(rows, "query_id long, variant int, rank int, entity_id long, item_id long, score double")
    assert {r.query_id: (r.entity_id, r.lead, r.answered) for r in R.rescued(lists).collect()} == {1: (5, 0.03, True), 2: (5, 0.02, False), 3: (None, None, False), 4: (5, 0.71, False), 5: (5, 0.72, True)}


def plain_followed(frames: list, height: float) -> set[tuple]:
    """Tracks by frame: best overlaps first, a track and a box once; three frames without a box end a track."""
    out, kept, following = set(), {}, {}
    for session, frame, listed in sorted(frames, key=lambda f: f[:2]):
        tracks = kept.setdefault(session, [])
        fresh = [b for b in listed if b.kind == "up" and b.long_side >= 0.045 * height]
        share = lambda p, q: plain_iou([[p.x, p.y], [p.x + p.w, p.y], [p.x + p.w, p.y + p.h], [p.x, p.y + p.h]], [[q.x, q.y], [q.x + q.w, q.y], [q.x + q.w, q.y + q.h], [q.x, q.y + q.h]])
        pairs = sorted((-share(t["box"], b), i, j) for i, t in enumerate(tracks) for j, b in enumerate(fresh) if share(t["box"], b) >= 0.3)
        taken: dict[int, int] = {}
        for _, i, j in pairs:
            if i not in taken.values() and j not in taken:
                taken[j] = i
        for i, t in enumerate(tracks):
            t["misses"] = 0 if i in taken.values() else t["misses"] + 1
        for j, b in enumerate(fresh):
            if j in taken:
                t = tracks[taken[j]]
                t["box"] = b
            else:
                following[session] = following.get(session, 0) + 1
                t = {"id": following[session], "box": b, "misses": 0}
                tracks.append(t)
            out.add((session, frame, b.id, t["id"]))
        kept[session] = [t for t in tracks if t["misses"] < 3]
    return out


def test_followed_tracks_by_walking_the_frames(spark, small):
    frames = [(r.session, r.frame, r.boxes) for r in plans.followed_frames(spark, small).collect()]
    wanted = plain_followed(frames, 1200.0)
    found = [tuple(r) for r in plans.followed_tracks(spark, small).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert max(t for *_, t in found) < len(found)  # some boxes go on with a track


def test_followed_stream_equals_its_batch_twin(spark, tmp_path):
    one = "struct<id: long, x: double, y: double, w: double, h: double, kind: string, long_side: double>"
    box = lambda k, i: (10 * k + i, 40.0 * i + k, 0.0, 20.0, 20.0, "down" if i == 1 else "up", 20.0 if i != 2 else 20.0 * (k % 2))
    rows = [{"session": s, "frame": k, "boxes": [box(k, i) for i in range(4)] if k != 2 else []} for k in range(6) for s in (1, 2)]
    schema = f"session long, frame long, boxes array<{one}>"
    out = streamed(spark, tmp_path, rows, schema, lambda d: processors.track_stream(processors.followed(d, 400.0)), 2)
    batch = processors.tracked(processors.followed(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 400.0)).toPandas()
    key = ["session", "frame", "box_id", "track"]
    assert sorted(out[key].itertuples(index=False, name=None)) == sorted(batch[key].itertuples(index=False, name=None))
    assert {b % 10 for b in batch["box_id"]} == {0, 2, 3} and {b for b in batch["box_id"] if b % 10 == 2} == {12, 32, 52}


@pytest.mark.parametrize("name", ["aligned_corners", "click_redetect", "cut_corners", "crop_parts", "shown_verdicts"])
def test_no_python_where_columns_do(spark, small, name):
    plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert ("MapInPandas" in plan) == (name == "click_redetect") and "CartesianProduct" not in plan and "NestedLoop" not in plan
