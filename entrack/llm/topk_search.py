"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and candidates into shards; every (block, shard) pair is one tile of
bounded size. A tile is one matrix product with a partial selection of the k best rows per query;
the per-tile lists are merged in a tree of fan-in 16.

Defined cases: a vector that is null, or holds a null or a non-finite component, takes no part on
either side; a null id takes no part; rows that repeat an id count once (the smallest vector in array
order); vectors of different lengths never match; ties go to the smaller id; fewer than k candidates
give all of them; empty tables give an empty result. Products beyond a long are held at its limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.llm.common import table

BLOCK_ROWS = 8192
SHARD_ROWS = 8192
FAN_IN = 16
_CHUNK = 256
_LONG = 2**63 - 1
_LIST = "query_id long, node long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float = 256.0) -> DataFrame:
    """(id, v): usable rows with components floor(scale * x), one row per id."""
    x = F.col(embedding)
    usable = x.isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    )
    whole = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.coalesce(usable, F.lit(False)))
        .select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
    )


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats only where every sum stays below 2**53."""
    most = max(np.abs(q.astype(float)).max(initial=0), 1) * max(np.abs(c.astype(float)).max(initial=0), 1)
    if most * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most * q.shape[1] < 2.0**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _tile(k: int):
    def best(key, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "node", "vec_id", "score")})
        queries, shard = rows[rows["asks"]], rows[~rows["asks"]]
        if queries.empty or shard.empty:
            return empty
        shard = shard.sort_values("id", kind="stable")
        ids = shard["id"].to_numpy(np.int64)
        cand = np.stack(shard["v"].to_numpy()).astype(np.int64)
        q_ids = queries["id"].to_numpy(np.int64)
        q_all = np.stack(queries["v"].to_numpy()).astype(np.int64)
        out = []
        for lo in range(0, len(q_ids), _CHUNK):
            own = q_ids[lo : lo + _CHUNK]
            score = _products(q_all[lo : lo + _CHUNK], cand)
            allowed = ids[None, :] != own[:, None]
            take = min(k + 1, len(ids))
            floor = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
            for r in range(len(own)):
                at = np.flatnonzero((score[r] >= floor[r]) & allowed[r])
                at = at[np.argsort(-score[r, at].astype(np.float64), kind="stable")] if abs(score[r, at]).max(initial=0) < 2**53 else np.array(sorted(at, key=lambda i: (-int(score[r, i]), i)), dtype=int)
                at = at[:k]
                out.append(np.column_stack([np.full(len(at), own[r]), np.full(len(at), key[1]), ids[at], score[r, at]]))
        rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pd.DataFrame(rows, columns=["query_id", "node", "vec_id", "score"])

    return best


def _kept(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row for which is_query holds.

    ``is_query`` is a condition on the column ``id``. Tiles hold at most about block_rows queries and
    shard_rows candidates whatever the size of the table.
    """
    rows = quantised(vectors, vec_id, embedding).withColumn("dim", F.size("v"))
    n, nq = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = -(-n // shard_rows) or 1, -(-nq // block_rows) or 1
    dealt = F.xxhash64(F.col("id"))
    left = rows.where(is_query).select(
        F.lit(True).alias("asks"), "id", "v", "dim", F.pmod(dealt, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    )
    right = rows.select(
        F.lit(False).alias("asks"), "id", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(dealt, F.lit(shards)).alias("shard")
    )
    tiles = left.unionByName(right).groupBy("block", "shard", "dim")
    lists = tiles.applyInPandas(_tile(k), _LIST)
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = _kept(lists.withColumn("node", F.floor(F.col("node") / FAN_IN)), ["query_id", "node"], k).drop("rank")
    return _kept(lists, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
