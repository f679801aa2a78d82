"""State per key over Structured Streaming: session logs, votes, zone gates, trackers and admission.

Each processor is a pair: a pure step that changes a small state, and a stream that keeps the state of each key
with applyInPandasWithState. A key's rows are taken in the order of ``order`` inside a micro-batch and in order
of arrival across them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def keyed_stream(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable, out: Callable, schema: str) -> DataFrame:
    """Runs ``step(state, row)`` over a key's rows and emits ``out(key, state, outputs)`` for each batch.

    The state is a dict of plain values, kept as JSON text.
    """
    import json

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else start()
        arrived = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        results = [step(kept, row) for row in arrived.itertuples(index=False)]
        state.update((json.dumps(kept),))
        yield out(key, kept, results)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "update", GroupStateTimeout.NoTimeout)


MOST_ENTRIES, REAPPEAR = 200, 20.0


def log_step(state: dict, row: tuple) -> None:
    """A sighting enters the log at the front or updates its entry; the oldest entries go."""
    entries = state["entries"]
    for e in entries:
        if e["entity"] == row.entity:
            e["times"] += row.time - e["last"] >= REAPPEAR
            e["last"] = max(e["last"], row.time)
            return
    entries.insert(0, {"entity": row.entity, "first": row.time, "last": row.time, "times": 1})
    del entries[MOST_ENTRIES:]


def session_log_stream(sightings: DataFrame) -> DataFrame:
    """(page, entity, first_time, last_time, appearances) after each batch. ``sightings``: page, seq, entity, time."""

    def out(key: tuple, state: dict, _: list) -> pd.DataFrame:
        rows = [(key[0], e["entity"], e["first"], e["last"], e["times"]) for e in state["entries"]]
        return pd.DataFrame(rows, columns=["page", "entity", "first_time", "last_time", "appearances"])

    return keyed_stream(sightings, ["page"], ["seq"], lambda: {"entries": []}, log_step, out, "page long, entity string, first_time double, last_time double, appearances long")


AGREE, CLEAR, TRIES = 2, 0.86, 4


def vote_step(state: dict, row: tuple) -> None:
    """One more reading of a track whose vote is still open."""
    if state["state"] != "voting":
        return
    entity = None if pd.isna(row.entity_id) else int(row.entity_id)
    state["reads"] += 1
    sure = bool(row.sure) and entity is not None
    if sure:
        state["sure"] += 1
        state["best"] = max(state["best"], row.score)
        state["entities"] = sorted({*state["entities"], entity})
    state["read"] += entity is not None
    state["still"] += entity is not None or not row.moving
    last = state["last"]
    same = last is not None and not row.sure and not last[1] and last[0] == entity and abs(last[2] - row.score) < 0.001
    state["last"] = [entity, bool(row.sure), row.score]
    if len(state["entities"]) == 1 and (state["sure"] >= AGREE or state["best"] >= CLEAR):
        state.update(state="promoted", entity=state["entities"][0], seq=int(row.seq))
    elif (state["read"] if state["sure"] else state["still"]) >= TRIES or state["reads"] >= 3 * TRIES or same:
        state.update(state="rejected", seq=int(row.seq))
    else:
        state["seq"] = int(row.seq)


def vote_start() -> dict:
    return {"state": "voting", "reads": 0, "sure": 0, "best": 0.0, "entities": [], "read": 0, "still": 0, "last": None, "entity": None, "seq": None}


def vote_stream(readings: DataFrame) -> DataFrame:
    """(track, state, entity_id, reads, seq) after each batch. ``readings``: track, seq, entity_id, sure, score, moving."""

    def out(key: tuple, s: dict, _: list) -> pd.DataFrame:
        return pd.DataFrame({"track": [key[0]], "state": [s["state"]], "entity_id": pd.array([s["entity"]], dtype="Int64"), "reads": [s["reads"]], "seq": [s["seq"]]})

    return keyed_stream(readings, ["track"], ["seq"], vote_start, vote_step, out, "track string, state string, entity_id long, reads long, seq long")


MOVING, QUIET, SETTLE = 6.0, 3.0, 2


def zone_step(state: dict, row: tuple) -> str:
    """A zone moves from a large difference on, settles after SETTLE quiet ones, and in between starts its run again."""
    if row.diff >= MOVING:
        state.update(moving=True, run=0)
        return "moving"
    if row.diff >= QUIET:
        state["run"] = 0
    elif state["moving"]:
        state["run"] += 1
        if state["run"] >= SETTLE:
            state.update(moving=False, run=0)
            return "settled"
    return "moving" if state["moving"] else "still"


def zone_stream(samples: DataFrame) -> DataFrame:
    """(zone, settles, moving) after each batch. ``samples``: zone, seq, diff."""

    def step(state: dict, row: tuple) -> None:
        state["settles"] += zone_step(state, row) == "settled"

    def out(key: tuple, s: dict, _: list) -> pd.DataFrame:
        return pd.DataFrame({"zone": [key[0]], "settles": [s["settles"]], "moving": [s["moving"]]})

    return keyed_stream(samples, ["zone"], ["seq"], lambda: {"moving": False, "run": 0, "settles": 0}, step, out, "zone long, settles long, moving boolean")


MATCH, MISSES = 0.3, 3


def _iou(a: list[float], b: list[float]) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def track_frame(state: dict, boxes: list[tuple[int, list[float]]]) -> list[tuple[int, int]]:
    """(box, track) of one frame: best overlaps first, one box a track; unmatched boxes open tracks."""
    pairs = sorted(((_iou(t["box"], box), ti, bi) for ti, t in enumerate(state["tracks"]) for bi, (_, box) in enumerate(boxes)), key=lambda p: (-p[0], p[1], p[2]))
    taken: dict[int, int] = {}
    for share, ti, bi in pairs:
        if share >= MATCH and ti not in taken.values() and bi not in taken:
            taken[bi] = ti
    for ti, t in enumerate(state["tracks"]):
        t["misses"] = 0 if ti in taken.values() else t["misses"] + 1
    out = []
    for bi, (box_id, box) in enumerate(boxes):
        if bi in taken:
            t = state["tracks"][taken[bi]]
            t["box"] = box
        else:
            t = {"id": state["next"], "box": box, "misses": 0}
            state["next"] += 1
            state["tracks"].append(t)
        out.append((box_id, t["id"]))
    state["tracks"] = [t for t in state["tracks"] if t["misses"] < MISSES]
    return out


# Fixed value: the least long side of a followed item, by the picture's height.
LEAST_SIDE = 0.045


def followed(frames: DataFrame, height: float, least_side: float = LEAST_SIDE) -> DataFrame:
    """Frames whose boxes are those worth following: up, and large enough. A frame left without boxes still counts as seen.

    ``frames``: session, frame, boxes (id, x, y, w, h, kind, long_side). A batch or a stream, before ``tracked`` or ``track_stream``.
    """
    large = F.filter("boxes", lambda b: (b.kind == "up") & (b.long_side / height >= least_side))
    return frames.withColumn("boxes", F.transform(large, lambda b: F.struct(b.id.alias("id"), b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"))))


def tracked(frames: DataFrame) -> DataFrame:
    """(session, frame, box_id, track) of all boxes: the batch twin. ``frames``: session, frame, boxes (id, x, y, w, h)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            rows = []
            for session, frame, boxes in zip(batch["session"], batch["frame"], batch["boxes"], strict=True):
                if session != current:
                    current, state = session, {"next": 1, "tracks": []}
                rows += [(session, frame, b, t) for b, t in track_frame(state, [(b["id"], [b["x"], b["y"], b["w"], b["h"]]) for b in boxes])]
            yield pd.DataFrame(rows, columns=["session", "frame", "box_id", "track"])

    dealt = frames.repartition("session").sortWithinPartitions("session", "frame")
    return dealt.mapInPandas(run, "session long, frame long, box_id long, track long")


def track_stream(frames: DataFrame) -> DataFrame:
    """The same over a stream; emits each batch's boxes."""

    def step(state: dict, row: tuple) -> list[tuple[int, int, int]]:
        return [(row.frame, b, t) for b, t in track_frame(state, [(int(b["id"]), [b["x"], b["y"], b["w"], b["h"]]) for b in row.boxes])]

    def out(key: tuple, _: dict, results: list) -> pd.DataFrame:
        rows = [(key[0], *r) for part in results for r in part]
        return pd.DataFrame(rows, columns=["session", "frame", "box_id", "track"])

    return keyed_stream(frames, ["session"], ["frame"], lambda: {"next": 1, "tracks": []}, step, out, "session long, frame long, box_id long, track long")
