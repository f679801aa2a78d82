"""Crowded cells: joins and choices in tiles against all pairs one by one."""

from __future__ import annotations

import numpy as np
import pytest
from test_assignment import plain_iou

from entrack.operators import geometry as G
from entrack.operators import tiles as T

BOX = "box_id long, x double, y double, w double, h double, conf double, frame long"


@pytest.fixture()
def small_tiles(monkeypatch):
    """Tiles of few rows, so that every cell is dealt into parts."""
    monkeypatch.setattr(T, "TILE_ROWS", 16)


def crowd(n: int = 140, seed: int = 5) -> list[tuple]:
    """Boxes on top of each other around one corner of four cells, with copies."""
    rng = np.random.default_rng(seed)
    at, size = rng.integers(-60, 60, (n, 2)), rng.integers(30, 90, (n, 2))
    rows = [(k, float(at[k, 0]), float(at[k, 1]), float(size[k, 0]), float(size[k, 1]), k % 10 / 10, k % 3) for k in range(n)]
    return rows + [(n + k, *rows[k][1:]) for k in range(10)]


def ring(b: tuple) -> list[list[float]]:
    return [[b[1], b[2]], [b[1] + b[3], b[2] + 5], [b[1] + b[3] - 5, b[2] + b[4]], [b[1] - 5, b[2] + b[4] - 5]]


def outlined(spark, rows: list[tuple], p: str):
    found = []
    for b in rows:
        q = ring(b)
        lo, hi = np.min(q, axis=0), np.max(q, axis=0)
        found.append((b[0], [v for point in q for v in point], *lo.tolist(), *(hi - lo).tolist()))
    return spark.createDataFrame(found, f"{p}_id long, {p}_quad array<double>, {p}x double, {p}y double, {p}w double, {p}h double")


def never_all_pairs(monkeypatch, most: int) -> None:
    """Fails where a step clips more outlines than ``most``."""
    plain = G.polygon_ious

    def counted(p, q):
        assert len(p) <= most
        return plain(p, q)

    monkeypatch.setattr(G, "polygon_ious", counted)


def test_outlines_of_crowded_cells_meet_once(spark, small_tiles):
    rows = crowd()
    wanted = {(a[0], b[0]): plain_iou(ring(a), ring(b)) for a in rows for b in rows if a[0] < b[0]}
    found = G.outlines_sharing(outlined(spark, rows, "a"), outlined(spark, rows, "b"), "a", "b", 0.3, 50.0, ordered=("a_id", "b_id"), kept=["a_id", "b_id"]).collect()
    assert len(found) == len({(r.a_id, r.b_id) for r in found})
    assert {(r.a_id, r.b_id): r.quad_iou for r in found} == pytest.approx({k: v for k, v in wanted.items() if round(v, 9) >= 0.3}, abs=1e-8)


def test_the_best_outline_of_each_in_crowded_cells(spark, small_tiles):
    rows = crowd()
    odd, even = [b for b in rows if b[0] % 2], [b for b in rows if b[0] % 2 == 0]
    found = G.outlines_sharing(outlined(spark, odd, "a"), outlined(spark, even, "b"), "a", "b", 0.5, 50.0, kept=["a_id", "b_id"], best=True).collect()
    top = {}
    for r in found:
        top[r.a_id] = max(top.get(r.a_id, (0.0, 0)), (r.quad_iou, -r.b_id))
    wanted = {a[0]: max((round(plain_iou(ring(a), ring(b)), 9), -b[0]) for b in even) for a in odd}
    wanted = {k: v for k, v in wanted.items() if v[0] >= 0.5}
    assert {k: -v[1] for k, v in top.items()} == {k: -v[1] for k, v in wanted.items()}
    assert len(found) < sum(plain_iou(ring(a), ring(b)) >= 0.5 for a in odd for b in even)  # not every pair


def shared(a: tuple, b: tuple) -> float:
    return max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))


def iou(a: tuple, b: tuple) -> float:
    return round(shared(a, b) / (a[3] * a[4] + b[3] * b[4] - shared(a, b)), 9)


def prefixed(d, p: str, key: str, *more: str):
    return d.selectExpr(f"box_id {key}", *more, *[f"{c} {p}{c}" for c in "xywh"])


def test_suppression_of_a_crowd_by_its_leaders(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(G, "LEADERS", 7)
    rows, stays = crowd(), []
    for b in sorted(rows, key=lambda b: (-b[5], b[0])):
        if not any(s[6] == b[6] and iou(s, b) > 0.3 for s in stays):
            stays.append(b)
    found = G.suppressed(spark.createDataFrame(rows, BOX), ["frame"], 0.3, 50.0).collect()
    assert {r.box_id for r in found} == {s[0] for s in stays} and len(found) == len(stays)


def test_first_boxes_of_points_in_crowded_cells(spark, small_tiles):
    rows = crowd()
    d = spark.createDataFrame(rows, BOX)
    points = d.selectExpr("box_id point_id", "x + 15 px", "y + 15 py")
    held = {p[0]: [b for b in rows if b[1] <= p[1] + 15 <= b[1] + b[3] and b[2] <= p[2] + 15 <= b[2] + b[4]] for p in rows}
    far = lambda p, b: (b[1] + b[3] / 2 - p[1] - 15) ** 2 + (b[2] + b[4] / 2 - p[2] - 15) ** 2
    small = {p[0]: min((b[3] * b[4], far(p, b), b[0]) for b in held[p[0]])[2] for p in rows}
    assert {r.point_id: r.box_id for r in G.boxes_at(points, d, 50.0).collect()} == small
    large = {p[0]: min((-b[3] * b[4], b[0]) for b in held[p[0]])[1] for p in rows}
    assert {r.point_id: r.box_id for r in G.first_boxes(points, d, 50.0, lambda b: (-b["w"] * b["h"],)).collect()} == large


def test_greedy_overlaps_level_by_level(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(G, "AT_ONCE", 0)
    monkeypatch.setattr(G, "LEVELS", (0.8, 0.4))
    rows = crowd()
    odd, even = [b for b in rows if b[0] % 2], [b for b in rows if b[0] % 2 == 0]
    left, right, wanted = set(), set(), set()
    for _, a, b in sorted((-iou(a, b), a[0], b[0]) for a in odd for b in even if iou(a, b) >= 0.05):
        if a not in left and b not in right:
            left.add(a), right.add(b), wanted.add((a, b))
    d = spark.createDataFrame(rows, BOX)
    found = G.greedy_overlaps(prefixed(d.where("box_id % 2 = 1"), "a", "a_id"), prefixed(d.where("box_id % 2 = 0"), "b", "b_id"), "a", "b", "a_id", "b_id", 0.05, 50.0)
    assert {(r.a_id, r.b_id) for r in found.collect()} == wanted


def test_links_of_a_crowd_hang_together_without_all_pairs(spark, small_tiles):
    from entrack.operators import graph

    rows = crowd()
    d = spark.createDataFrame(rows, BOX)
    links = G.overlap_links(prefixed(d, "a", "a_id"), prefixed(d, "b", "b_id"), "a", "b", "a_id", "b_id", 0.5, 50.0)
    group = {b[0]: b[0] for b in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if group[b[0]] < group[a[0]] and iou(a, b) >= 0.5:
                    group[a[0]] = group[b[0]]
    assert {r.node: r.group_id for r in graph.groups(d.selectExpr("box_id node"), links).collect()} == group


def test_pairs_frames_parts_and_centres_in_crowded_cells(spark, small_tiles):
    rows = crowd()
    d = spark.createDataFrame(rows, BOX)
    a, b = prefixed(d, "a", "a_id", "frame af"), prefixed(d, "b", "b_id", "frame bf")
    met = G.overlapping(a, b, "a", "b", 0.3, 50.0, ordered=("a_id", "b_id"), kept=["a_id", "b_id"]).collect()
    assert sorted((r.a_id, r.b_id, r.iou) for r in met) == sorted((p[0], q[0], iou(p, q)) for p in rows for q in rows if p[0] < q[0] and iou(p, q) >= 0.3)
    seen = {(p[0], q[6]) for p in rows for q in rows if abs(p[6] - q[6]) >= 2 and shared(p, q) > 0 and iou(p, q) >= 0.2}
    assert {(r.a_id, r.bf) for r in G.seen_in_frames(a, b, "a", "b", 0.2, 50.0, 2).collect()} == seen
    mid = lambda p, q: q[1] <= p[1] + p[3] / 2 <= q[1] + q[3] and q[2] <= p[2] + p[4] / 2 <= q[2] + q[4]
    base, extra = [p for p in rows if p[5] >= 0.8], [p for p in rows if p[5] < 0.8]
    kept = {p[0] for p in base} | {p[0] for p in extra if not any(shared(p, q) > 0 and (mid(p, q) or mid(q, p)) for q in base)}
    assert {r.box_id for r in G.without_centre_matches(d.where("conf >= 0.8"), d.where("conf < 0.8"), 50.0).collect()} == kept
