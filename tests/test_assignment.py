"""Sequential rules, greedy operators, streams and stores against plain versions and planted cases."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest

from entrack.operators import assignment as A
from entrack.operators import geometry as G
from entrack.operators import index as I  # noqa: E741
from entrack.operators import vectors as V
from entrack.plans import registry
from entrack.plans.assignment import quads
from entrack.plans.spatial import boxes
from entrack.streaming import processors


@pytest.fixture(scope="module")
def frame(spark, small):
    return boxes(spark, small).toPandas()


def shared(p, q) -> float:
    w = min(p.x + p.w, q.x + q.w) - max(p.x, q.x)
    h = min(p.y + p.h, q.y + q.h) - max(p.y, q.y)
    return max(0.0, w) * max(0.0, h)


def iou(p, q) -> float:
    both = shared(p, q)
    return round(both / (p.w * p.h + q.w * q.h - both), 9)


def test_suppression_by_walking_down_the_confidences(spark, small, frame):
    kept = set()
    for _, rows in frame.groupby("frame"):
        stays = []
        for p in sorted(rows.itertuples(), key=lambda p: (-p.conf, p.box_id)):
            if not any(iou(p, q) > 0.1 for q in stays):
                stays.append(p)
        kept |= {p.box_id for p in stays}
    assert {r.box_id for r in registry.QUERIES["nms"](spark, small).collect()} == kept


def test_outline_suppression_by_walking_down_the_scores(spark, small):
    shape = {r.box_id: r for r in boxes(spark, small).select("box_id", "frame", "conf", G.corners(*[_c(c) for c in "xywh"], _c("conf") * 45).alias("quad")).collect()}
    kept: dict[int, list] = {}
    for r in sorted(shape.values(), key=lambda r: (-r.conf, r.box_id)):
        stays = kept.setdefault(r.frame, [])
        if not any(plain_iou(r.quad, s.quad) > 0.1 for s in stays):
            stays.append(r)
    wanted = {s.box_id for stays in kept.values() for s in stays}
    found = {r.box_id for r in registry.QUERIES["nms_outlines"](spark, small).collect()}
    assert found == wanted and found != {r.box_id for r in registry.QUERIES["nms"](spark, small).collect()}


def plain_iou(p: list, q: list) -> float:
    """One pair of convex polygons, clipped point by point."""

    def area(s: list) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(s, [*s[1:], *s[:1]], strict=True)) / 2

    q = list(q) if area(list(q)) > 0 else list(q)[::-1]
    left = list(p)
    for a, b in zip(q, [*q[1:], q[0]], strict=True):
        inside = lambda z: (b[0] - a[0]) * (z[1] - a[1]) - (b[1] - a[1]) * (z[0] - a[0])  # noqa: B023, E731
        now, left = left, []
        for u, v in zip(now, [*now[1:], *now[:1]], strict=True):
            s, t = inside(u), inside(v)
            left += [u] if s >= 0 else []
            left += [[u[k] + (v[k] - u[k]) * s / (s - t) for k in (0, 1)]] if s * t < 0 else []
    both = abs(area(left)) if left else 0.0
    joint = abs(area(list(p))) + abs(area(q)) - both
    return both / joint if joint > 0 else 0.0


def test_overlaps_of_whole_arrays_equal_pairs_one_by_one():
    rng = np.random.default_rng(2)
    angles = np.sort(rng.uniform(0, 2 * np.pi, (400, 4)), axis=1)
    rings = np.stack([np.cos(angles), np.sin(angles)], axis=2) * rng.uniform(0.5, 2, (400, 1, 1)) + rng.uniform(-1, 1, (400, 1, 2))
    rings[::7] = rings[::7, ::-1]
    rings[5] = rings[5, :1]  # no area
    p, q = rings[:200], rings[200:]
    assert np.allclose(G.polygon_ious(p, q), [plain_iou(a.tolist(), b.tolist()) for a, b in zip(p, q, strict=True)])
    every = G.outline_shares(p[:40], q[:40])
    assert np.allclose(every, [[plain_iou(a.tolist(), b.tolist()) for b in q[:40]] for a in p[:40]])
    shared = G.polygon_ious(G.as_polygons([[[0, 0], [2, 0], [1, 2]], [[0, 0], [1, 0], [1, 1], [0, 1]]]), G.as_polygons([[[0, 0], [2, 0], [2, 2], [0, 2]], [[5, 5], [6, 5], [5, 6]]]))
    assert np.allclose(shared, [0.5, 0.0])


def test_greedy_matches_by_walking_down_the_scores(spark, small, frame):
    strong, weak = ([p for p in frame.itertuples() if (p.conf >= 0.5) == s] for s in (True, False))
    pairs = sorted(((-iou(p, q), p.box_id, q.box_id) for p in strong for q in weak if shared(p, q) > 0 and iou(p, q) >= 0.05))
    left, right, wanted = set(), set(), set()
    for _, a, b in pairs:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            wanted.add((a, b))
    assert {(r.a_id, r.b_id) for r in registry.QUERIES["greedy_cover"](spark, small).collect()} == wanted


def test_long_chains_end_the_same(spark):
    """Chains of falling scores and of overlapping boxes, longer than the rounds."""
    chain = [(0, k // 2, (k + 1) // 2, 1.0 - k / 1000) for k in range(60)]
    left, right, wanted = set(), set(), set()
    for _, a, b, _ in chain:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            wanted.add((a, b))
    found = G.greedy_pairs(spark.createDataFrame(chain, "g int, a long, b long, score double"), ["g"], "a", "b", "score")
    assert {(r.a, r.b) for r in found.collect()} == wanted
    rows = [(0, k, 10.0 * k, 0.0, 15.0, 10.0, 1.0 - k / 1000) for k in range(30)]
    stays = G.suppressed(spark.createDataFrame(rows, "frame int, box_id long, x double, y double, w double, h double, conf double"), ["frame"], 0.1, 20.0)
    assert {r.box_id for r in stays.collect()} == set(range(0, 30, 2))


def grid_iou(a: np.ndarray, b: np.ndarray) -> float:
    """By counting points of a fine grid."""
    points = np.stack(np.meshgrid(*[np.linspace(min(a[:, k].min(), b[:, k].min()), max(a[:, k].max(), b[:, k].max()), 220) for k in (0, 1)]), -1).reshape(-1, 2)

    def inside(p: np.ndarray) -> np.ndarray:
        turns = [np.sign((q[0] - o[0]) * (points[:, 1] - o[1]) - (q[1] - o[1]) * (points[:, 0] - o[0])) for o, q in zip(p, np.roll(p, -1, axis=0), strict=True)]
        return np.all(np.array(turns) >= 0, axis=0) | np.all(np.array(turns) <= 0, axis=0)

    x, y = inside(a), inside(b)
    return (x & y).sum() / max(1, (x | y).sum())


def test_quad_overlaps_by_counting_points(spark, small):
    shape = {r.box_id: np.array(r.quad) for r in boxes(spark, small).select("box_id", G.corners(*[_c(c) for c in "xywh"], _c("conf") * 45).alias("quad")).collect()}
    found = registry.QUERIES["quad_overlap"](spark, small).collect()
    assert len(found) > 20
    for r in found[:60]:
        assert grid_iou(shape[r.a_id], shape[r.b_id]) == pytest.approx(r.quad_iou, abs=0.03)


def _c(name):
    from pyspark.sql import functions as F

    return F.col(name)


def plain_tracks(rows: list[dict], least: float, kinds: bool) -> dict[int, int]:
    """Each frame's detections to the best free track, by trying all pairs again and again."""
    tracks, out = [], {}
    for _, dets in itertools.groupby(rows, key=lambda r: r["frame"]):
        dets, free = list(dets), list(range(len(tracks)))
        open_dets = list(range(len(dets)))
        while True:
            tries = [(-G.polygon_iou(tracks[t]["quad"], A.quad(dets[i])), i, t) for i in open_dets for t in free if not kinds or tracks[t]["kind"] == dets[i]["kind"]]
            tries = [x for x in tries if -x[0] >= least]
            if not tries:
                break
            _, i, t = min(tries)
            out[dets[i]["box_id"]] = t
            tracks[t]["quad"] = A.quad(dets[i])
            open_dets.remove(i)
            free.remove(t)
        for i in open_dets:
            out[dets[i]["box_id"]] = len(tracks)
            tracks.append({"kind": dets[i]["kind"], "quad": A.quad(dets[i])})
    return out


def test_batch_tracks(spark, small):
    rows = [r.asDict() for r in quads(spark, small).orderBy("session", "frame", "box_id").collect()]
    wanted = {}
    for _, own in itertools.groupby(rows, key=lambda r: r["session"]):
        wanted |= plain_tracks(list(own), 0.5, True)
    assert {r.box_id: r.track for r in registry.QUERIES["batch_tracks"](spark, small).collect()} == wanted


def square(x: float, y: float, side: float = 10.0) -> list[list[float]]:
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


def det(frame: int, box: int, x: float, kind: str = "up") -> dict:
    return {"frame": frame, "box_id": box, "kind": kind, "quad": square(x, 0.0)}


def test_tracks_keep_kinds_apart_and_bridge_a_gap():
    rows = [det(0, 1, 0), det(0, 2, 50, "down"), det(1, 3, 1), det(2, 4, 51), det(4, 5, 2), det(4, 6, 50, "down")]
    assert {r["box_id"]: r["track"] for r in A.batch_tracks(0.5)(rows)} == {1: 0, 2: 1, 3: 0, 4: 2, 5: 0, 6: 1}


def test_frames_are_scored_by_confidence():
    row = lambda i, label, kind, conf, x: {"box_id": i, "is_label": label, "kind": kind, "conf": conf, "quad": square(x, 0.0)}
    rows = [row(1, True, "up", 0, 0), row(2, True, "down", 0, 100), row(3, True, "ignore", 0, 200), row(4, True, "up", 0, 300)]
    rows += [row(11, False, "up", 0.9, 1), row(12, False, "up", 0.8, 0), row(13, False, "up", 0.7, 100), row(14, False, "up", 0.9, 201), row(15, False, "up", 0.9, 500), row(16, False, "up", 0.1, 300)]
    found = {(r["label_id"], r["box_id"]): r["outcome"] for r in A.scored_frame(0.4)(rows)}
    assert found == {(1, 11): "right", (2, 13): "down-as-up", (4, None): "missed", (None, 15): "false"}
    px, relative = A.corner_error(np.roll(np.array(square(3, 4)), 2, axis=0), np.array(square(0, 0)))
    assert (px, relative) == pytest.approx((5.0, 0.5))


def test_reading_order_looks_at_the_first_of_a_row():
    box = lambda i, x, y: {"box_id": i, "x": x, "y": y, "w": 10.0, "h": 10.0}
    rows = sorted([box(1, 50, 0), box(2, 0, 4), box(3, 20, 8), box(4, 0, 30)], key=lambda b: b["y"])
    assert [r["box_id"] for r in A.reading_order(rows)] == [2, 1, 3, 4]


def test_boxes_of_one_frame_do_not_drop_each_other():
    rows = [{"box_id": i, "frame": f, "quad": square(x, 0)} for i, f, x in ((1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 40))]
    assert [r["box_id"] for r in A.deduped(0.5)(rows)] == [1, 2, 4]


def test_merged_tiles_prefer_whole_boxes():
    box = lambda i, cut, conf, x, w: {"box_id": i, "cut": cut, "conf": conf, "x": x, "y": 0.0, "w": w, "h": 10.0}
    rows = [box(1, True, 0.9, 0, 10.0), box(2, False, 0.5, 0, 10.5), box(3, False, 0.8, 30, 10.0), box(4, True, 0.99, 31, 10.0), box(5, False, 0.4, 61, 3.0), box(6, False, 0.3, 60, 30.0)]
    assert [r["box_id"] for r in A.merged_tiles(rows, 0.5, 0.7)] == [3, 2, 6]


def test_rereads_checks_and_staged_keys():
    seq = lambda moved, entity: {"moved": moved, "entity_id": entity}
    rows = [{"seq": i} | r for i, r in enumerate([seq(False, 7.0), seq(False, 7.0), seq(True, None), seq(False, None), seq(False, 8.0)])]
    assert [(r["reads"], r["before"]) for r in A.rereads(rows)] == [(1, None), (2, None), (2, None), (0, 7), (1, 7)]
    visit = lambda at, over, quiet=False, found=False: {"seq": at, "at": at, "over": over, "quiet": quiet, "found": found}
    rows = [visit(0, True), visit(5, True), visit(11, True), visit(12, True, True), visit(13, True), visit(14, True), visit(20, False), visit(21, True), visit(32, True, found=True), visit(33, True)]
    assert [r["due"] for r in A.checks(2, 10)(rows)] == [False, False, True, False, True, False, False, False, True, False]
    use = lambda key, put: {"seq": 0, "key": key, "put": put}
    rows = [use(1, True), use(2, True), use(1, True), use(3, True), use(1, False), use(2, False), use(3, False)]
    assert [r["found"] for r in A.staged(2)(rows)] == [False, True, True]


def test_cascade_of_decisions(spark, small):
    found = {r.item: r.decision for r in registry.QUERIES["decision_cascade"](spark, small).collect()}
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, label = e["vec_id"].tolist(), dict(zip(e["vec_id"], e["label"], strict=True))
    vectors = np.stack(e["embedding"].to_numpy()).astype(float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    table = np.round(unit @ unit.T, 6)
    score = {(i, j): table[x, y] for x, i in enumerate(ids) for y, j in enumerate(ids) if i != j}
    first = dict(zip(ids, vectors[:, 0], strict=True))
    new, held = [i for i in ids if i % 2], [i for i in ids if not i % 2]
    own = {i: [j for j in held if label[j] == label[i]] for i in new}
    decision = {i: "covered" for i in new if any(score[i, j] >= 0.45 for j in own[i])}
    taken_new, taken_own = set(), set()
    for _, i, j in sorted((-score[i, j], i, j) for i in new for j in own[i] if score[i, j] >= 0.35):
        if i not in taken_new and j not in taken_own:
            taken_new.add(i)
            taken_own.add(j)
    decision |= dict.fromkeys(taken_new, "covered")
    decision |= {i: "placeholder" for i in new if i not in decision and first[i] >= 0.2}

    def sets(rest: list, met) -> dict:
        group = {i: i for i in rest}
        for _ in rest:
            before = dict(group)
            for i in rest:
                for j in rest:
                    if i != j and met(i, j) and score[i, j] >= 0.45:
                        group[i] = group[j] = min(group[i], group[j])
            if group == before:
                return group
        return group

    rest = [i for i in new if i not in decision]
    decision |= {i: "duplicate" for i, g in sets(rest, lambda i, j: label[i] == label[j]).items() if i != g}
    decision |= {i: "shared" for i in rest if i not in decision and any(score[i, j] >= 0.45 for j in held if label[j] != label[i])}
    rest = [i for i in rest if i not in decision]
    across = sets(rest, lambda i, j: label[i] != label[j])
    sizes = [*across.values()]
    decision |= {i: "look-alike" if sizes.count(g) > 1 else "added" for i, g in across.items()}
    assert found == decision and len(set(decision.values())) >= 4


@pytest.mark.parametrize("tile_rows", [2048, 40])
def test_similar_pairs_equal_all_products(spark, tile_rows):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 12))
    vectors = np.concatenate([middles[k % 6] + rng.normal(scale=0.4, size=12) for k in range(299)]).reshape(299, 12)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, [0.0] * 12)]
    found = V.similar_pairs(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 0.8, tile_rows).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    table = np.round(unit @ unit.T, V.SCORE_DIGITS)
    assert {(r.a, r.b) for r in found} == {(i, j) for i in range(299) for j in range(i + 1, 299) if table[i, j] >= 0.8} and len(found) == len({(r.a, r.b) for r in found})
    assert V.similar_pairs(spark.createDataFrame([], "id long, vec array<double>"), "id", "vec", 0.8).count() == 0


def test_index_guards_raise(spark):
    make = lambda ids: spark.createDataFrame(list(enumerate(ids)), "pos long, item_id long")
    assert I.appended(make([1, 2]), make([-101])).count() == 3
    for base, extras in (([1, -101], [-102]), ([1], [2]), ([1], [-101, -101])):
        with pytest.raises(ValueError):
            I.appended(make(base), make(extras))
    with pytest.raises(ValueError):
        I.stripped(make([1, -101, 2]))
    assert I.stripped(make([1, 2, -101])).count() == 2


def streamed(spark, tmp_path, rows: list[dict], schema: str, build, parts: int) -> pd.DataFrame:
    """The last state of each key after the rows came in ``parts`` files, one a batch."""
    root, name = tmp_path / "in", f"out{abs(hash(str(tmp_path))) % 10**8}"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    names = list(rows[0])
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame([tuple(r[n] for n in names) for r in part], frame.schema).coalesce(1).write.mode("append").parquet(str(root))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store for each
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(root))
    held: list[pd.DataFrame] = []
    query = build(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: held.append(df.toPandas())).queryName(name).trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination(240)
    assert query.exception() is None
    return pd.concat(held, ignore_index=True)


def test_vote_stream(spark, tmp_path):
    read = lambda track, seq, entity, sure, score=0.5: {"track": track, "seq": seq, "entity_id": entity, "sure": sure, "score": score, "moving": False}
    rows = [read("a", 1, 5, True), read("b", 2, 6, True, 0.9), read("c", 3, 7, False), read("a", 4, 5, True), read("c", 5, 7, False), read("d", 6, 1, True), read("d", 7, 2, True)]
    out = streamed(spark, tmp_path, rows, "track string, seq long, entity_id long, sure boolean, score double, moving boolean", processors.vote_stream, 3)
    last = out.groupby("track").last()
    assert last["state"].to_dict() == {"a": "promoted", "b": "promoted", "c": "rejected", "d": "voting"}
    assert last.loc["a", "entity_id"] == 5


def test_zone_stream(spark, tmp_path):
    rows = [{"zone": 1, "seq": i, "diff": d} for i, d in enumerate([9.0, 2.0, 4.0, 1.0, 1.0, 7.0, 1.0])]
    out = streamed(spark, tmp_path, rows, "zone long, seq long, diff double", processors.zone_stream, 2)
    assert out.iloc[-1]["settles"] == 1 and bool(out.iloc[-1]["moving"])


def test_track_stream_equals_its_batch_twin(spark, tmp_path):
    boxes_of = lambda k: [{"id": 10 * k + i, "x": 40.0 * i + k, "y": 0.0, "w": 20.0, "h": 20.0} for i in range(3)]
    rows = [{"session": s, "frame": k, "boxes": [tuple(b.values()) for b in boxes_of(k)]} for k in range(4) for s in (1, 2)]
    schema = "session long, frame long, boxes array<struct<id:long,x:double,y:double,w:double,h:double>>"
    out = streamed(spark, tmp_path, rows, schema, processors.track_stream, 2)
    batch = processors.tracked(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).toPandas()
    key = ["session", "frame", "box_id", "track"]
    assert sorted(out[key].itertuples(index=False, name=None)) == sorted(batch[key].itertuples(index=False, name=None))
    assert set(out["track"]) == {1, 2, 3}
