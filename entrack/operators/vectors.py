"""Vector columns and exact nearest entities.

An index is a table (pos, item_id, entity_id, vec): ``pos`` fixes the order of items, and so all ties. Scores
are rounded to SCORE_DIGITS so that sums in another order cannot change a rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entrack.operators import tiles as T
from entrack.operators.graph import groups
from entrack.operators.lineage import cut

SCORE_DIGITS = 6
BLOCK_ROWS, SHARD_ROWS = 1024, 4096


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vec: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    size = F.array(F.sqrt(dot(vec, vec)))  # worked out once, not for each component
    return F.transform(size, lambda n: F.transform(vec, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))[0]


def quantised(vec: Column) -> Column:
    """Components as bytes: half up after clipping to [-1, 1] and scaling by 127."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127 + 0.5).cast("byte"))


def pooled(vec: Column, tokens: int, how: str) -> Column:
    """Pools a flat token-by-dimension array: the first token or the mean of all."""
    dim = (F.size(vec) / tokens).cast("int")
    if how == "first":
        return F.slice(vec, F.lit(1), dim)
    return F.transform(
        F.sequence(F.lit(0), dim - 1),
        lambda d: F.aggregate(F.sequence(F.lit(0), F.lit(tokens - 1)), F.lit(0.0), lambda s, t: s + F.get(vec, t * dim + d).cast("double")) / tokens,
    )


_TILE = "query_id long, variant int, entity_id long, item_id long, pos long, first_pos long, score double"


def _tile(scale: float):
    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        queries, index = rows[asks], rows[~asks].sort_values("pos", kind="stable")
        if queries.empty or index.empty:
            return pd.DataFrame(columns=["query_id", "variant", "entity_id", "item_id", "pos", "first_pos", "score"])
        vectors = np.stack(index["vec"].to_numpy()).astype(np.float64)
        entity, item, pos = (index[c].to_numpy(np.int64) for c in ("entity_id", "item_id", "pos"))
        order = np.argsort(entity, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(entity[order]) != 0])
        sizes, places = np.diff(np.append(starts, len(order))), np.arange(len(order))
        out = []
        for lo in range(0, len(queries), 128):
            part = queries.iloc[lo : lo + 128]
            score = np.round(np.stack(part["vec"].to_numpy()).astype(np.float64) @ vectors.T * scale, SCORE_DIGITS)[:, order]
            own = part["item_id"].to_numpy(np.int64)
            score[item[order][None, :] == own[:, None]] = -np.inf
            top = np.maximum.reduceat(score, starts, axis=1)
            # the earliest of equal scores, and the earliest item that counts
            at = np.minimum.reduceat(np.where(score == np.repeat(top, sizes, axis=1), places, len(order)), starts, axis=1)
            first = np.minimum.reduceat(np.where(np.isfinite(score), places, len(order)), starts, axis=1)
            q, e = np.nonzero(np.isfinite(top))
            best, seen = order[at[q, e]], order[first[q, e]]
            out.append(pd.DataFrame({"query_id": own[q], "variant": part["variant"].to_numpy()[q], "entity_id": entity[best], "item_id": item[best], "pos": pos[best], "first_pos": pos[seen], "score": top[q, e]}))
        return pd.concat(out, ignore_index=True)

    return best


def entity_scores(index: DataFrame, queries: DataFrame, scale: float = 1.0) -> DataFrame:
    """(query_id, variant, entity_id, item_id, score, first_pos): each entity's best item for each query vector.

    ``queries``: query_id, variant, vec. An item never answers for itself (query_id = item_id). Queries are
    dealt into blocks and the index into shards; each pair of them is one matrix product of bounded size.
    """
    shards = max(1, -(-index.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    none = F.lit(None).cast("long")
    asked = queries.select(
        F.lit(True).alias("asks"), F.col("query_id").alias("item_id"), "variant", none.alias("entity_id"), none.alias("pos"), doubles(F.col("vec")).alias("vec"),
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    held = index.select(
        F.lit(False).alias("asks"), "item_id", F.lit(None).cast("int").alias("variant"), F.col("entity_id").cast("long"), F.col("pos").cast("long"), doubles(F.col("vec")).alias("vec"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"),
    )
    tiles = asked.unionByName(held).groupBy("block", "shard").applyInPandas(_tile(scale), _TILE)
    best = tiles.groupBy("query_id", "variant", "entity_id").agg(
        F.max(F.struct("score", (-F.col("pos")).alias("minus_pos"), "item_id")).alias("b"), F.min("first_pos").alias("first_pos")
    )
    return best.select("query_id", "variant", "entity_id", F.col("b.item_id").alias("item_id"), F.col("b.score").alias("score"), "first_pos")


def top_entities(scores: DataFrame, k: int) -> DataFrame:
    """The k best entities of each query vector; equal scores rank by the entity's first position."""
    order = Window.partitionBy("query_id", "variant").orderBy(F.col("score").desc(), "first_pos", "entity_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows on each side of a tile of the similarity join, and most pivots, whose table of distances is held by the driver.
TILE_ROWS, MOST_PIVOTS = 2048, 256
_SLACK = 1e-6


def similar_pairs(rows: DataFrame, key: str, vec: str, least: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b, score): all pairs of rows, a < b, whose cosine is at least ``least``, rounded to SCORE_DIGITS.

    Rows gather round pivots, which are rows of the table, one for each tile and MOST_PIVOTS at most; a pivot's rows lie within
    an angle of it. Two pivots further apart than both angles and that of ``least`` together have no pair, so their
    tiles never meet. The others are matrix products of bounded size; only pairs that reach ``least`` leave a
    tile. Vectors without a length have no pairs; keys are longs and unique.
    """
    unit = rows.select(F.col(key).cast("long").alias("id"), doubles(F.col(vec)).alias("vec")).where(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0)
    unit = cut(unit.select("id", normalised(F.col("vec")).alias("vec")))
    n = unit.count()
    picked = unit.orderBy(F.xxhash64("id")).limit(min(MOST_PIVOTS, max(1, -(-n // tile_rows)))).toArrow()  # MOST_PIVOTS rows
    if not n:
        return unit.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score"))
    pivots = np.stack(picked.column("vec").to_pylist())

    def placed(batches):
        for batch in batches:
            if len(batch):
                cosine = np.clip(np.stack(batch["vec"].to_numpy()) @ pivots.T, -1, 1)
                cell = cosine.argmax(axis=1)
                yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "cell": cell, "angle": np.arccos(cosine[np.arange(len(cell)), cell])})

    dealt = cut(unit.mapInPandas(placed, "id long, vec array<double>, cell int, angle double"))
    cells = {r.cell: (r.far, -(-r.n // tile_rows)) for r in dealt.groupBy("cell").agg(F.max("angle").alias("far"), F.count("*").alias("n")).collect()}  # MOST_PIVOTS rows
    apart, reach = np.arccos(np.clip(pivots @ pivots.T, -1, 1)), float(np.arccos(np.clip(least - 10.0**-SCORE_DIGITS, -1, 1))) + _SLACK
    tiles = {c: [(c, t) for t in range(cells[c][1])] for c in cells}
    met = [(a, b) for a in cells for b in cells if a <= b and apart[a, b] - cells[a][0] - cells[b][0] <= reach]
    partners = {c: [] for c in cells}
    for a, b in met:
        partners[a].append((a, b))
        if a != b:
            partners[b].append((a, b))
    spark = rows.sparkSession
    listed = spark.createDataFrame([(c, [{"left": a, "right": b, "m": len(tiles[a]), "n": len(tiles[b])} for a, b in of], len(tiles[c])) for c, of in partners.items()], "cell int, met array<struct<left: int, right: int, m: int, n: int>>, parts int")
    # a row of one cell meets all tiles of the other; inside a cell, tiles t <= u
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    spread = dealt.join(F.broadcast(listed), "cell").withColumn("own", own).select("id", "vec", "cell", "own", F.explode("met").alias("p")).select("id", "vec", "cell", "own", "p.*")
    others = F.sequence(F.lit(0), F.when(F.col("cell") == F.col("left"), F.col("n")).otherwise(F.col("m")) - 1)
    spread = spread.withColumn("other", F.explode(others))
    inside = F.col("left") == F.col("right")
    t = F.when(inside, F.least("own", "other")).when(F.col("cell") == F.col("left"), F.col("own")).otherwise(F.col("other"))
    u = F.when(inside, F.greatest("own", "other")).when(F.col("cell") == F.col("left"), F.col("other")).otherwise(F.col("own"))
    side = F.when(inside, F.col("own") == t).otherwise(F.col("cell") == F.col("left"))

    def product(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        left = part["side"].to_numpy(bool)
        same = key[0] == key[1] and key[2] == key[3]
        x, y = (part, part) if same else (part[left], part[~left])
        out = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(x) and len(y):
            ids, vectors = y["id"].to_numpy(np.int64), np.stack(y["vec"].to_numpy())
            for lo in range(0, len(x), 512):
                some = x.iloc[lo : lo + 512]
                score = np.round(np.stack(some["vec"].to_numpy()) @ vectors.T, SCORE_DIGITS)
                i, j = np.nonzero(score >= least)
                p, q = some["id"].to_numpy(np.int64)[i], ids[j]
                keep = p < q if same else p != q
                out.append(pd.DataFrame({"a": np.minimum(p, q)[keep], "b": np.maximum(p, q)[keep], "score": score[i, j][keep]}))
        return pd.concat(out, ignore_index=True)

    return spread.select("id", "vec", "left", "right", t.alias("t"), u.alias("u"), side.alias("side")).groupBy("left", "right", "t", "u").applyInPandas(product, "a long, b long, score double")


#: Rows of a part and of the hub that every part of a group meets, and cells of a table of scores that is held at once.
PART_ROWS, HUB_ROWS, SCORES = 4096, 1024, 2**20


def units(rows: DataFrame, key: str, vec: str, *also: str) -> DataFrame:
    """``key`` and vec, of unit length, with the columns ``also``; rows with a null in these or without a length go."""
    made = rows.select(F.col(key).cast("long").alias(key), *also, doubles(F.col(vec)).alias("vec")).where(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) > 0)
    return made.dropna(subset=[key, *also]).select(key, *also, normalised(F.col("vec")).alias("vec"))


def one_cell(rows: DataFrame) -> DataFrame:
    """The rows as ``tiles.tiled`` takes them, all in one cell."""
    return rows.withColumns({"_cx": F.lit(0), "_cy": F.lit(0)})


def _reached(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the rows of x and y whose product, rounded, is at least ``least``."""
    step = max(1, SCORES // max(1, len(y)))
    for lo in range(0, len(x), step):
        table = x[lo : lo + step] @ y.T
        i, j = np.nonzero(table >= least - 10.0**-SCORE_DIGITS)
        score = np.round(table[i, j], SCORE_DIGITS)
        ok = score >= least
        yield lo + i[ok], j[ok], score[ok]


def scored_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float, within: list[str]) -> DataFrame:
    """(within, left_id, right_id, score): pairs with a cosine of at least ``least`` inside a group. Both sides: ``units``."""

    def rule(_cx: int, _cy: int, l: T.Arrays, r: T.Arrays) -> Iterator[T.Arrays]:
        for i, j, score in _reached(l["vec"], r["vec"], least):
            yield {"_l": i, "_r": j, "score": score}

    return T.tiled(one_cell(left), one_cell(right), [left_id], [right_id], rule, within, "score double", ([*within, left_id], [right_id]))


def like_any(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float, within: list[str] | None = None, apart: str | None = None) -> DataFrame:
    """The left ids that have a cosine of at least ``least`` with any right row: of their group, or with another value of ``apart``."""

    def test(l: T.Arrays, r: T.Arrays) -> np.ndarray:
        met = np.round(l["vec"] @ r["vec"].T, SCORE_DIGITS) >= least
        return met & (l[apart][:, None] != r[apart]) if apart else met

    return T.tiled(one_cell(left), one_cell(right), [left_id], [right_id], T.any_met([left_id], test), within, "", ([left_id], [])).distinct()


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least one that it hangs together with, through the pairs (i, j) in any number of steps."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            to = np.arange(n)
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(to[to], to):
                to = to[to]
            root = to[root]
    return root


def similar_groups(rows: DataFrame, key: str, vec: str, least: float, within: str | None = None, apart: str | None = None) -> DataFrame:
    """(node, group_id): rows linked by cosines of at least ``least``, in any number of steps; the smallest node names a group.

    Only rows with the same value of ``within`` are linked, or only those with another value of ``apart``. Rows are dealt into parts
    of PART_ROWS, each of which is compared with itself and with a hub of some HUB_ROWS rows of its group. What hangs
    together then as the largest set of a group is not compared with itself again; the others meet all rows of the group, in
    tiles. No pair of rows leaves a task, only one link a row and tile at most.
    """
    also = [c for c in (within, apart) if c]
    of = F.col(within) if within else F.lit(0)
    unit = cut(units(rows, key, vec, *also).select(F.col(key).alias("id"), "vec", of.alias("_of"), (F.col(apart) if apart else F.lit(0)).alias("_apart")))
    nodes = rows.select(F.col(key).cast("long").alias("node"))
    size = min(PART_ROWS, T.TILE_ROWS)

    def links(with_own: bool) -> T.Rule:
        def rule(_cx: int, _cy: int, l: T.Arrays, r: T.Arrays) -> Iterator[T.Arrays]:
            ids, vectors, kind = (np.concatenate([l[c], r[c]]) for c in ("id", "vec", "_apart"))
            own, first = len(l["id"]), 0 if with_own else len(l["id"])

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j, _ in _reached(vectors[:own], vectors[first:], least):
                    ok = kind[i] != kind[first + j] if apart else np.ones(len(i), bool)
                    yield i[ok], first + j[ok]

            root = joined(len(ids), pairs())
            linked = np.flatnonzero(root != np.arange(len(ids)))
            yield {"a": ids[linked], "b": ids[root[linked]]}

        return rule

    counts = unit.groupBy("_of").agg(F.count("*").alias("_n")).where(F.col("_n") > min(size, HUB_ROWS))
    parts, hubs = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)), F.coalesce(F.ceil(F.col("_n") / HUB_ROWS), F.lit(1))
    counted = unit.join(F.broadcast(counts), "_of", "left")  # a row for HUB_ROWS rows at most
    dealt = counted.withColumns({"_cx": F.pmod(F.xxhash64("id"), parts), "_cy": F.lit(0)}).drop("_n")
    hub = counted.where(F.pmod(F.xxhash64("id", F.lit(1)), hubs) == 0).withColumns({"_cx": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "_cy": F.lit(0)}).drop("_n")
    found = cut(T.tiled(dealt, hub, ["id"], ["id"], links(True), ["_of"], "a long, b long"))
    if counts.where(F.col("_n") > size).isEmpty():
        return groups(nodes, found)
    known = cut(unit.select("id", "_of").join(groups(unit.select(F.col("id").alias("node")), found).withColumnRenamed("node", "id"), "id"))
    sizes = known.groupBy("_of", "group_id").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("_of").agg(F.max_by("group_id", F.struct("n", "group_id")).alias("largest"))
    rest = known.join(largest, "_of").where("group_id <> largest").select("id")
    rest = cut(unit.join(rest, "id", "left_semi"))
    more = T.tiled(one_cell(rest), one_cell(unit), ["id"], ["id"], links(False), ["_of"], "a long, b long")
    return groups(nodes, cut(found.unionByName(more)))
