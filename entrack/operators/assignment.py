"""Sequential rules inside small groups: reading order, greedy assignment, tracks over frames, re-reads.

A group is a frame or a session; each is folded by one small function on its rows, and Spark deals groups to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from entrack.operators.geometry import Outlines, outline_shares, polygon_iou, polygon_ious


def by_group(rows: DataFrame, keys: list[str], order: list[str], rule: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``rule`` over the rows of each group in order. Rows stream through sorted partitions, one group at a time."""
    names = [part.strip().split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []

        def done() -> pd.DataFrame:
            found = [dict(zip(keys, current, strict=True)) | r for r in rule(held)]
            return pd.DataFrame(found, columns=names)

        for batch in batches:
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current and held:
                    yield done()
                    held = []
                current = key
                held.append(row)
        if held:
            yield done()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def reading_order(rows: list[dict]) -> list[dict]:
    """Boxes by rows, then from left to right. A box is in the row whose first member it is near enough to in height.

    Rows: box_id, x, y, w, h, by the height of their middle.
    """
    lines: list[list[dict]] = []
    for box in rows:
        middle = box["y"] + box["h"] / 2
        first = lines[-1][0] if lines else None
        if first and middle - (first["y"] + first["h"] / 2) < min(first["h"], box["h"]) / 2:
            lines[-1].append(box)
        else:
            lines.append([box])
    ordered = [b for line in lines for b in sorted(line, key=lambda b: b["x"] + b["w"] / 2)]
    return [{"box_id": b["box_id"], "place": i} for i, b in enumerate(ordered)]


def quad(row: dict) -> np.ndarray:
    return np.stack([np.asarray(p, dtype=float) for p in row["quad"]])


def inside_share(a: np.ndarray, b: np.ndarray) -> float:
    """How much of a polygon lies in another, from the overlap that their union gives."""
    area = lambda p: abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]))) / 2
    share = polygon_iou(a, b)
    both = share * (area(a) + area(b)) / (1 + share)
    return both / area(a) if area(a) > 0 else 0.0


ON_LABEL, ON_IGNORE, MATCH = 0.3, 0.5, 0.5


def corner_error(found: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Least mean distance of the corners over the four turns, in pixels and against the label's shorter side."""
    px = min(float(np.hypot(*(np.roll(found, -turn, axis=0) - label).T).mean()) for turn in range(4))
    side = min(float(np.hypot(*(label[1] - label[0]))), float(np.hypot(*(label[3] - label[0]))))
    return px, px / max(1.0, side)


def scored_frame(least_conf: float) -> Callable[[list[dict]], list[dict]]:
    """Detections of a frame against its labels, the surest first, one label each.

    Rows: box_id, is_label, kind, conf, quad; the kind of a label to look away from is ``ignore``. A second detection on
    a label, or one on a label to ignore, is not a false one. Gives a row for each label and each false detection.
    """

    def rule(rows: list[dict]) -> list[dict]:
        found = sorted((r for r in rows if not r["is_label"] and r["conf"] >= least_conf), key=lambda r: (-r["conf"], r["box_id"]))
        real = [r for r in rows if r["is_label"] and r["kind"] != "ignore"]
        ignored = [quad(r) for r in rows if r["is_label"] and r["kind"] == "ignore"]
        shapes, taken, out = [quad(r) for r in real], {}, []
        labels, away = (Outlines(np.stack([x.ravel() for x in some]) if some else np.zeros((0, 8))) for some in (shapes, ignored))
        free = np.ones(len(shapes), bool)
        for d in found:
            one = Outlines(quad(d).reshape(1, -1))
            near, share_at_most = one.near(labels, ON_LABEL)
            shares = np.full(len(near), np.nan)

            def clip(at: np.ndarray) -> np.ndarray:
                at = at[np.isnan(shares[at])]  # noqa: B023
                shares[at] = polygon_ious(np.repeat(one.points, len(at), axis=0), labels.points[near[at]])  # noqa: B023
                return shares  # noqa: B023

            best, waiting, upto = MATCH, np.flatnonzero(free[near] & (share_at_most >= MATCH - 1e-8)), 4
            while len(waiting):  # those that may overlap most come first
                best = max(best, float(clip(waiting[:upto])[waiting[:upto]].max()))
                waiting, upto = waiting[upto:], upto * 2
                waiting = waiting[share_at_most[waiting] + 1e-8 >= best]
            fits = np.flatnonzero(free[near] & (shares >= MATCH))
            if len(fits):
                _, i = max((round(float(shares[k]), 9), int(near[k])) for k in fits)  # of equal ones the last
                taken[i], free[i] = d, False
                continue
            if any((clip(np.arange(lo, min(lo + 64, len(near))))[lo : lo + 64] >= ON_LABEL).any() for lo in range(0, len(near), 64)):
                continue
            other, _ = one.near(away, 0.0)
            both = polygon_ious(np.repeat(one.points, len(other), axis=0), away.points[other])
            inside = both * (one.area + away.area[other]) / (1 + both) / max(float(one.area[0]), 1e-300) if one.area[0] > 0 else 0 * both
            if not ((inside >= ON_IGNORE) | (both >= ON_LABEL)).any():
                out.append({"label_id": None, "box_id": d["box_id"], "outcome": "false", "px": None, "relative": None})
        for i, r in enumerate(real):
            d = taken.get(i)
            px, relative = corner_error(quad(d), shapes[i]) if d else (None, None)
            outcome = "missed" if d is None else "right" if d["kind"] == r["kind"] else f"{r['kind']}-as-{d['kind']}"
            out.append({"label_id": r["box_id"], "box_id": d and d["box_id"], "outcome": outcome, "px": px and round(px, 6), "relative": relative and round(relative, 6)})
        return out

    return rule


def batch_tracks(least: float) -> Callable[[list[dict]], list[dict]]:
    """Tracks through the frames of a session: a detection joins the track of its kind whose last member it overlaps most.

    Rows: frame, box_id, kind, quad, by frame. A track may miss frames; best overlaps first, one detection a track.
    """

    def rule(rows: list[dict]) -> list[dict]:
        tracks: list[dict] = []
        out = []
        frames: dict[int, list[dict]] = {}
        for r in rows:
            frames.setdefault(r["frame"], []).append(r)
        for dets in frames.values():
            shapes = [quad(d) for d in dets]
            met = outline_shares(np.stack([t["quad"] for t in tracks]), np.stack(shapes)) if tracks else np.zeros((0, len(dets)))
            pairs = [(met[t, i], t, i) for t, i in zip(*(x.tolist() for x in np.nonzero(met >= least)), strict=True) if tracks[t]["kind"] == dets[i]["kind"]]
            owner: dict[int, int] = {}
            taken: set[int] = set()
            for _, t, i in sorted(pairs, key=lambda p: (-p[0], p[2], p[1])):
                if i not in owner and t not in taken:
                    owner[i] = t
                    taken.add(t)
            for i, d in enumerate(dets):
                if i not in owner:
                    owner[i] = len(tracks)
                    tracks.append({"id": len(tracks), "kind": d["kind"]})
                tracks[owner[i]]["quad"] = shapes[i]
                out.append({"frame": d["frame"], "box_id": d["box_id"], "track": owner[i]})
        return out

    return rule


def deduped(least: float) -> Callable[[list[dict]], list[dict]]:
    """Of boxes of different frames that overlap, the brightest; boxes of one frame never drop each other.

    Rows: box_id, frame, quad, the brightest first.
    """

    def rule(rows: list[dict]) -> list[dict]:
        out, frames, shapes = [], [], np.zeros((len(rows), 4, 2))
        for r in rows:
            q, n = quad(r), len(out)
            others = np.array(frames[:n], dtype=object) != r["frame"]
            if n and (outline_shares(shapes[:n], q[None])[:, 0][others] >= least).any():
                continue
            shapes[n] = q
            frames.append(r["frame"])
            out.append({"box_id": r["box_id"], "frame": r["frame"]})
        return out

    return rule


def merged_tiles(rows: list[dict], same: float, inside: float) -> list[dict]:
    """Boxes of overlapping tiles as one list: whole ones before cut ones, the surest first, no box twice.

    Rows: box_id, cut, conf, x, y, w, h. A cut box also goes where a whole one holds most of it.
    """

    ids, is_cut, conf = (np.array([r[c] for r in rows]) for c in ("box_id", "cut", "conf"))
    box = np.array([[r[c] for c in "xywh"] for r in rows], float).reshape(-1, 4)
    area = box[:, 2] * box[:, 3]

    def tables(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the boxes a share with the boxes b, and their overlap."""
        p, q = box[a, None], box[None, b]
        w, h = (np.minimum(p[..., k] + p[..., k + 2], q[..., k] + q[..., k + 2]) - np.maximum(p[..., k], q[..., k]) for k in (0, 1))
        both = np.maximum(0.0, w) * np.maximum(0.0, h)
        return both, both / (area[a, None] + area[None, b] - both)

    large = np.argsort(-area, kind="stable")
    whole, lo, step = np.arange(len(rows)), 0, 16  # against the largest boxes first: what is a part of one is not looked at again
    while lo < len(rows) and len(whole):
        some, left = large[lo : lo + step], []
        for at in range(0, len(whole), 512):
            own = whole[at : at + 512]
            both, share = tables(own, some)
            part = (area[some][None] > area[own, None]) & (both / area[own, None] >= inside) & (share <= same)
            left.append(own[~part.any(axis=1)])
        whole, lo, step = np.concatenate(left), lo + step, min(512, step * 2)
    order = whole[np.lexsort((ids[whole], -conf[whole], is_cut[whole]))]
    kept = np.zeros(0, int)

    def drops(r: np.ndarray, k: np.ndarray) -> np.ndarray:
        both, share = tables(r, k)
        return (share > same) | (is_cut[r, None] & ~is_cut[None, k] & (both / area[r, None] >= inside))

    for lo in range(0, len(order), 256):
        some = order[lo : lo + 256]
        for at in range(0, len(kept), 1024):
            some = some[~drops(some, kept[at : at + 1024]).any(axis=1)]
        table, stays = drops(some, some), np.zeros(len(some), bool)
        for n in range(len(some)):
            stays[n] = not (table[n, :n] & stays[:n]).any()
        kept = np.concatenate([kept, some[stays]])
    kept = kept[np.lexsort((ids[kept], -conf[kept]))]
    return [{"box_id": int(b), "place": i} for i, b in enumerate(ids[kept])]


def rereads(rows: list[dict]) -> list[dict]:
    """A track's votes start again where its zone moved after its last read and is quiet again.

    Rows: seq, moved, entity_id (null: not read then). Gives for every row how many reads count, and the entity that
    was named before the last fresh start (two equal reads name one).
    """
    reads: list[int] = []
    named, before, moved, out = None, None, False, []
    for r in rows:
        moved = moved or bool(r["moved"])
        if moved and not r["moved"] and reads:
            before, reads, named = named, [], None
        if not r["moved"]:
            moved = False
        if not pd.isna(r["entity_id"]):
            reads.append(int(r["entity_id"]))
            if len(reads) >= 2 and reads[-1] == reads[-2]:
                named = reads[-1]
        out.append({"seq": r["seq"], "reads": len(reads), "before": before})
    return out


def checks(tries: int, gap: float) -> Callable[[list[dict]], list[dict]]:
    """When a listed item is looked at again during a pointer's visits.

    Rows: seq, at, over (the pointer is on it), quiet, found. A visit starts when the pointer comes; a check is due
    ``gap`` after that, never on a quiet spot, and at most ``tries`` times a visit while checks find nothing.
    """

    def rule(rows: list[dict]) -> list[dict]:
        began, used, settled, out = None, 0, False, []
        for r in rows:
            if not r["over"]:
                began, used, settled = None, 0, False
            elif began is None:
                began = r["at"]
            due = began is not None and not r["quiet"] and not settled and used < tries and r["at"] - began >= gap
            if due:
                used += 1
                settled = bool(r["found"])
            out.append({"seq": r["seq"], "due": due})
        return out

    return rule


def staged(most: int) -> Callable[[list[dict]], list[dict]]:
    """Keys held by a map of ``most`` entries that drops its oldest: whether each use finds its key.

    Rows: seq, key, put. Putting a key again keeps its age.
    """

    def rule(rows: list[dict]) -> list[dict]:
        held: dict[object, None] = {}
        out = []
        for r in rows:
            if r["put"]:
                held[r["key"]] = None
                if len(held) > most:
                    del held[next(iter(held))]
            else:
                out.append({"seq": r["seq"], "found": r["key"] in held})
        return out

    return rule
