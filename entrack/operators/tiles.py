"""Pairs of boxes in tiles: rows meet in grid cells, crowded cells are dealt into parts, and arrays are compared inside tasks.

A tile holds TILE_ROWS rows of each side at most, on average, however crowded a cell is. A rule gets a tile's two sides as
arrays and gives only what it found, so pairs that do not count never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows on each side of a tile, and cells of a table of comparisons that is held at once.
TILE_ROWS, BLOCK = 8192, 2**18

Arrays = dict[str, np.ndarray]
Rule = Callable[[int, int, Arrays, Arrays], Iterator[Arrays]]


def cells(prefix: str, cell: float) -> Column:
    """The grid cells that a box touches, as an array of (cx, cy)."""

    def span(at: str, size: str) -> Column:
        return F.sequence(F.floor(F.col(prefix + at) / cell), F.floor((F.col(prefix + at) + F.col(prefix + size)) / cell))

    return F.flatten(F.transform(span("x", "w"), lambda cx: F.transform(span("y", "h"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def in_cells(rows: DataFrame, prefix: str, cell: float) -> DataFrame:
    return rows.select("*", F.explode(cells(prefix, cell)).alias("_c")).select("*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")).drop("_c")


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """A column as an array; lists of one length as rows of it."""
    held = column.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) and held.num_chunks == 1 else held
    if pa.types.is_list(held.type) and len(held):
        sizes = np.diff(held.offsets.to_numpy())
        if held.null_count == 0 and sizes[0] > 0 and (sizes == sizes[0]).all():
            return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
        most = max(int(sizes.max()), 2)
        full = [[*row, *(row[-2:] * most)][:most] if row else [np.nan] * most for row in held.to_pylist()]  # shorter outlines repeat their last point
        return np.array(full, float)
    return held.to_numpy(zero_copy_only=False)


def tiled(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], rule: Rule, frame: list[str] | None = None, extra: str = "", kept: tuple[list[str], list[str]] = ((), ())) -> DataFrame:
    """What ``rule`` finds in each tile. Both sides: the columns of frame, _cx, _cy and what the rule reads.

    Rows of a crowded cell are dealt by the columns ``left_id`` and ``right_id``. The rule yields arrays of the columns ``extra`` (a schema); with ``kept``, also the numbers _l and _r of two rows, whose
    columns of these names come first.
    """
    keys = [*(frame or []), "_cx", "_cy"]
    sides = [left.dropna(subset=keys), right.dropna(subset=keys)]
    crowded = [d.groupBy(*keys).agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias(n)).where(F.col(n) > 1) for d, n in zip(sides, ("_p", "_q"), strict=True)]
    dealt = []
    for rows, own, other, of, parts, others in ((sides[0], "_i", "_j", left_id, "_p", "_q"), (sides[1], "_j", "_i", right_id, "_q", "_p")):
        for c in crowded:
            rows = rows.join(F.broadcast(c), keys, "left")  # a row for TILE_ROWS rows at most
        rows = rows.withColumn(own, F.pmod(F.xxhash64(*of), F.coalesce(parts, F.lit(1)).cast("long")).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop("_p", "_q")
        dealt.append(rows.select(*[F.col(c).alias(c) for c in rows.columns]))  # both sides may come from one table
    schema = StructType([*[left.schema[n] for n in kept[0]], *[right.schema[n] for n in kept[1]], *(StructType.fromDDL(extra).fields if extra else [])])
    form = to_arrow_schema(schema)
    at = len(keys) - 2

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return form.empty_table()
        l, r = ({n: _array(t.column(n)) for n in t.column_names if n not in ("_cx", "_cy", "_i", "_j")} for t in (a, b))
        found = []
        for part in rule(key[at].as_py(), key[at + 1].as_py(), l, r):
            own = [a.column(n).take(pa.array(part["_l"])) for n in kept[0]] + [b.column(n).take(pa.array(part["_r"])) for n in kept[1]]
            more = [pa.array(part[f.name], f.type) for f in list(form)[len(own) :]]
            found.append(pa.Table.from_arrays([*own, *more], names=form.names).cast(form))
        return pa.concat_tables(found) if found else form.empty_table()

    grouped = [*keys, "_i", "_j"]
    return dealt[0].groupBy(*grouped).cogroup(dealt[1].groupBy(*grouped)).applyInArrow(run, schema)


def touching(l: Arrays, r: Arrays, a: str, b: str, areas: tuple[np.ndarray, np.ndarray], least: float, before: tuple[str, str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, shared area) of boxes that share an area, without those that share too little of their two ``areas`` for the overlap ``least``.

    The areas may be those of outlines inside the boxes, which share no more than the boxes do. ``before``: only pairs whose left id is less.
    """
    need = least / (1 + least) * (1 - 1e-7)
    own, other = areas[0] * need, areas[1] * need
    lx, ly, lw, lh = (l[a + c] for c in "xywh")
    down = np.argsort(r[b + "x"], kind="stable")
    rx, ry, rw, rh = (r[b + c][down] for c in "xywh")
    lx2, ly2, rx2, ry2 = lx + lw, ly + lh, rx + rw, ry + rh
    ids = (l[before[0]], r[before[1]][down]) if before else None
    other = other[down]
    widest, start = float(np.nanmax(rw)), 0
    across = np.argsort(lx, kind="stable")
    while start < len(lx):
        i = across[start : start + 16]
        lo, hi = np.searchsorted(rx, lx[i].min() - widest), np.searchsorted(rx, lx2[i].max(), side="right")
        i = across[start : start + max(1, min(512, BLOCK // max(1, hi - lo)))]
        start += len(i)
        lo, hi = np.searchsorted(rx, lx[i].min() - widest), np.searchsorted(rx, lx2[i].max(), side="right")
        if hi <= lo:
            continue
        w = np.minimum(lx2[i, None], rx2[None, lo:hi]) - np.maximum(lx[i, None], rx[None, lo:hi])
        h = np.minimum(ly2[i, None], ry2[None, lo:hi]) - np.maximum(ly[i, None], ry[None, lo:hi])
        np.maximum(w, 0.0, out=w)
        both = w * np.maximum(h, 0.0, out=h)
        ok = both > 0
        if need > 0:
            ok &= both >= own[i, None] + other[None, lo:hi]
        at = np.flatnonzero(ok)
        p, q = np.divmod(at, hi - lo)
        if ids:
            kept = ids[0][i[p]] < ids[1][lo + q]
            at, p, q = at[kept], p[kept], q[kept]
        if len(p):
            yield i[p], down[lo + q], both.ravel()[at]


def at_home(cx: int, cy: int, x: np.ndarray, y: np.ndarray, cell: float) -> np.ndarray:
    """Whether a pair counts in this cell: it holds the upper left corner of the common part, so a pair comes out once."""
    return (np.floor(x / cell) == cx) & (np.floor(y / cell) == cy)


def box_pairs(a: str, b: str, least: float, cell: float, ordered: tuple[str, str] | None) -> Rule:
    """Pairs of rows with their overlap, from just under ``least`` on; the caller rounds it."""

    def rule(cx: int, cy: int, l: Arrays, r: Arrays) -> Iterator[Arrays]:
        left_area, right_area = l[a + "w"] * l[a + "h"], r[b + "w"] * r[b + "h"]
        for i, j, both in touching(l, r, a, b, (left_area, right_area), least, ordered):
            share = both / (left_area[i] + right_area[j] - both)
            ok = (share >= least - 1e-8) & at_home(cx, cy, np.maximum(l[a + "x"][i], r[b + "x"][j]), np.maximum(l[a + "y"][i], r[b + "y"][j]), cell)
            yield {"_l": i[ok], "_r": j[ok], "iou": share[ok]}

    return rule


def any_met(keys: list[str], test: Callable[[Arrays, Arrays], np.ndarray], first: Callable[[Arrays], np.ndarray] | None = None) -> Rule:
    """Numbers (_l) of left rows that at least one right row of the tile meets. ``test`` gives a table of left by right rows.

    Right rows are taken in the order of the key ``first``, a few and then more at once; a row that was met is not looked at again.
    """

    def rule(_cx: int, _cy: int, l: Arrays, r: Arrays) -> Iterator[Arrays]:
        n = len(next(iter(r.values())))
        r = {k: v[np.argsort(first(r), kind="stable")] for k, v in r.items()} if first else r
        open_, lo, step = np.arange(len(l[keys[-1]])), 0, 16
        while lo < n and len(open_):
            some = {k: v[lo : lo + step] for k, v in r.items()}
            rows, met = max(1, BLOCK // step), []
            for at in range(0, len(open_), rows):
                part = {k: v[open_[at : at + rows]] for k, v in l.items()}
                met.append(test(part, some).any(axis=1))
            met = np.concatenate(met)
            if met.any():
                yield {"_l": open_[met]}
            open_, lo, step = open_[~met], lo + step, min(1024, step * 2)

    return rule


def linked(a: str, b: str, least: float, left_id: str, right_id: str) -> Rule:
    """(node, linked) pairs that hang together as all pairs of the tile with the overlap ``least`` do, one a box at most.

    Both sides of a tile are walked breadth first; what is reached is not looked at again.
    """

    def rule(_cx: int, _cy: int, l: Arrays, r: Arrays) -> Iterator[Arrays]:
        box = [np.concatenate([l[a + c], r[b + c]]) for c in "xywh"]
        ids, sides = np.concatenate([l[left_id], r[right_id]]), np.repeat([0, 1], [len(l[left_id]), len(r[right_id])])
        order = np.argsort(box[0], kind="stable")
        (x, y, w, h), ids, sides = (v[order] for v in box), ids[order], sides[order]
        x2, y2, area = x + w, y + h, w * h
        widest = [float(w[sides == s].max()) if (sides == s).any() else 0.0 for s in (0, 1)]
        waiting = [np.flatnonzero(sides == s) for s in (0, 1)]  # not reached yet, by x
        node, to = [], []

        def near(k: int) -> np.ndarray:
            s = 1 - sides[k]
            held = waiting[s]
            lo, hi = np.searchsorted(x[held], x[k] - widest[s]), np.searchsorted(x[held], x2[k], side="right")
            c = held[lo:hi]
            both = np.maximum(0.0, np.minimum(x2[k], x2[c]) - np.maximum(x[k], x[c])) * np.maximum(0.0, np.minimum(y2[k], y2[c]) - np.maximum(y[k], y[c]))
            hit = (both > 0) & (np.floor(both / (area[k] + area[c] - both) * 1e9 + 0.5) / 1e9 >= least)
            if hit.any():
                kept = np.ones(len(held), bool)
                kept[lo:hi][hit] = False
                waiting[s] = held[kept]
            return c[hit]

        for start in range(len(ids)):
            if sides[start] or not len(waiting[1]):
                continue
            s = np.searchsorted(waiting[0], start)
            if s == len(waiting[0]) or waiting[0][s] != start:
                continue
            waiting[0] = np.delete(waiting[0], s)
            frontier = [start]
            while frontier:
                k = frontier.pop()
                if not len(waiting[1 - sides[k]]):
                    continue
                reached = near(k)
                if len(reached):
                    node.append(ids[reached])
                    to.append(np.full(len(reached), ids[k]))
                    frontier.extend(reached.tolist())
        if node:
            yield {"a": np.concatenate(node), "b": np.concatenate(to)}

    return rule


def leaders(rows: DataFrame, rank: str, most: int) -> DataFrame:
    """_cx, _cy, _last: for each cell of more than ``most`` rows, up to where ``rank`` goes in the first of them, a quarter to a half of ``most``."""
    cell = ["_cx", "_cy"]
    crowded = rows.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    shares = F.array(*[F.lit(0.5**k) for k in range(1, 41)])
    last = rows.join(F.broadcast(crowded), cell).groupBy(*cell, "_n").agg(F.percentile_approx(rank, shares, 10_000).alias("_at"))
    return last.select(*cell, F.element_at("_at", F.ceil(F.log2(F.col("_n") * 2 / most)).cast("int")).alias("_last"))


def first_holding(far: Callable[[Arrays, Arrays], np.ndarray] | None = None, more: tuple[str, ...] = ()) -> Rule:
    """For each point (px, py) of a tile, the first box (x, y, w, h, box_id) by its rank that holds it.

    Of boxes of one rank, ``far`` (a table of points by boxes) decides, then box_id. Gives point_id, box_id, rank, far and the
    box's columns ``more``. Boxes are taken in order, a few and then more at once; a point that a box holds is not looked at again.
    """

    def rule(_cx: int, _cy: int, l: Arrays, r: Arrays) -> Iterator[Arrays]:
        down = np.lexsort((r["box_id"], r["rank"]))
        r = {k: v[down] for k, v in r.items()}
        key = r["rank"]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # where boxes of one key end
        open_, lo, step = np.arange(len(l["px"])), 0, 16
        while lo < len(key) and len(open_):
            hi = int(ends[np.searchsorted(ends, min(lo + step, len(key)))])
            box = {k: v[lo:hi] for k, v in r.items()}
            x2, y2, left = box["x"] + box["w"], box["y"] + box["h"], []
            for at in range(0, len(open_), max(1, BLOCK // (hi - lo))):
                some = open_[at : at + max(1, BLOCK // (hi - lo))]
                px, py = l["px"][some, None], l["py"][some, None]
                held = (px >= box["x"]) & (px <= x2) & (py >= box["y"]) & (py <= y2)
                any_ = held.any(axis=1)
                left.append(some[~any_])
                if not any_.any():
                    continue
                held, some = held[any_], some[any_]
                best = held.argmax(axis=1)
                away = np.zeros(len(some))
                if far:
                    apart = np.where(held & (key[lo:hi][None] == key[lo + best][:, None]), far({k: v[some] for k, v in l.items()}, box), np.inf)
                    best = apart.argmin(axis=1)  # of equally far ones the smaller id, which comes first
                    away = apart[np.arange(len(some)), best]
                yield {"point_id": l["point_id"][some], "box_id": box["box_id"][best], "rank": key[lo + best], "far": away, **{c: box[c][best] for c in more}}
            open_, lo, step = np.concatenate(left), hi, min(1024, step * 2)

    return rule
