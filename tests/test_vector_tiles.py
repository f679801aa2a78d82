"""Vectors in tiles: groups and matches against all products, without all pairs as rows."""

from __future__ import annotations

import numpy as np
import pytest

from entrack.operators import geometry as G
from entrack.operators import tiles as T
from entrack.operators import vectors as V

ROWS = "id long, vec array<double>, label int"


@pytest.fixture()
def tiles_made(monkeypatch):
    """Tiles and parts of few rows; what leaves the tiles, one table a call."""
    for name, n in (("PART_ROWS", 40), ("HUB_ROWS", 8), ("SCORES", 300)):
        monkeypatch.setattr(V, name, n)
    monkeypatch.setattr(T, "TILE_ROWS", 16)
    made, plain = [], T.tiled
    monkeypatch.setattr(T, "tiled", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    return made


def vectors() -> tuple[list[tuple], np.ndarray]:
    """A large set, some small ones, lone rows and copies under two labels; one row without a length, one without a label."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(9, 12))
    near = np.concatenate([middles[0 if k % 3 else k % 9] + rng.normal(scale=0.3, size=12) for k in range(140)]).reshape(-1, 12)
    x = np.concatenate([near, rng.normal(size=(20, 12)), near[:10]])
    rows = [(1000 - k, v.tolist(), k % 2) for k, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [*rows, (2, [0.0] * 12, 0), (3, x[0].tolist(), None)], np.round(unit @ unit.T, V.SCORE_DIGITS)


def plain_groups(rows: list[tuple], scores: np.ndarray, least: float, met) -> dict[int, int]:
    group = {r[0]: r[0] for r in rows}
    pairs = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(scores >= least), strict=True) if i != j and met(rows[i][2], rows[j][2])]
    for _ in rows:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    return group


def test_similar_groups_are_found_without_all_pairs(spark, tiles_made):
    rows, scores = vectors()
    d = spark.createDataFrame(rows, ROWS)
    for least in (0.6, 0.85, 0.97):
        found = {r.node: r.group_id for r in V.similar_groups(d, "id", "vec", least, within="label").collect()}
        assert found == plain_groups(rows, scores, least, lambda p, q: p == q)
    found = {r.node: r.group_id for r in V.similar_groups(d, "id", "vec", 0.85, apart="label").collect()}
    wanted = plain_groups(rows, scores, 0.85, lambda p, q: p != q)
    assert found == wanted and len(set(wanted.values())) > 5
    every = sum(scores[i, j] >= 0.6 for i in range(170) for j in range(i) if rows[i][2] == rows[j][2])
    assert sum(t.count() for t in tiles_made[:2]) < every / 3


def test_matches_of_a_group_are_settled_level_by_level(spark, tiles_made, monkeypatch):
    monkeypatch.setattr(G, "AT_ONCE", 0)
    rows, scores = vectors()
    at = {r[0]: k for k, r in enumerate(rows[:170])}
    new, own = [[r for r in rows[:170] if r[0] % 4 // 2 == s] for s in (0, 1)]
    every = sorted((-scores[at[p[0]], at[q[0]]], p[0], q[0]) for p in new for q in own if p[2] == q[2] and scores[at[p[0]], at[q[0]]] >= 0.35)
    left, right, wanted = set(), set(), set()
    for _, a, b in every:
        if a not in left and b not in right:
            left.add(a), right.add(b), wanted.add((a, b))
    unit = V.units(spark.createDataFrame(rows, ROWS), "id", "vec", "label")
    sides = [unit.where(f"int(id % 4 / 2) = {s}").withColumnRenamed("id", name) for s, name in ((0, "item"), (1, "own"))]
    found = G.greedy_by_level(*sides, ["label"], "item", "own", "score", 0.35, (0.9, 0.7), lambda l, r, v: V.scored_pairs(l, r, "item", "own", v, ["label"])).collect()
    assert {(r.item, r.own) for r in found} == wanted and len(found) == len(wanted)
    assert sum(t.count() for t in tiles_made) < len(every)
    clear = {r.item for r in V.like_any(*sides, "item", "own", 0.9, None, "label").collect()}
    assert clear == {p[0] for p in new if any(p[2] != q[2] and scores[at[p[0]], at[q[0]]] >= 0.9 for q in own)}
