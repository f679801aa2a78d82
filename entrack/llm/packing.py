"""Packing by optimal length buckets.

One pass writes the length of every row and builds the global histogram of distinct lengths. A dynamic program
over the histogram chooses the bucket bounds that minimise padding: with sorted lengths, best[k][j] = min over i of
best[k-1][i] + the padding of lengths i..j when each is padded to the longest. The best i never falls as j grows,
so each bucket costs n log n. The optimum is exact for all lengths: rows with d distinct lengths hold d * d / 2
words at least, so 100 TB of text have some six million at most, and the driver holds three numbers for each.
Inside each bucket, rows form batches of at most ``budget`` padded tokens; a row longer than the budget has a batch
of its own.

Batches need the place of each row in its bucket. A bucket may hold most of the rows, so places are
counted inside shards of a bucket and shifted by the sizes of the shards before: only the last batch of
each bucket is not full. Shards come from a hash of the id and of ``spread``, so rows that share an id, or
have none, are dealt apart by their texts.

Defined cases: null and empty texts have length 0 and go to the first bucket (a bucket of width 0 counts
as width 1 against the budget); null ids are ordinary rows; repeated rows are packed as often as they
occur; rows of equal length are interchangeable; an empty table gives an empty result; extra columns of
the input stay out of the result unless listed in ``keep``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entrack.llm.common import WORD_PATTERN, Scratch, table

BUCKETS = 16
BUDGET = 16_384
SHARD_ROWS = 20_000
MOST_SHARDS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0))


def histogram(lengths: DataFrame) -> np.ndarray:
    """Rows of (length, rows) by length."""
    counts = lengths.groupBy("length").agg(F.count("*").alias("rows")).toArrow()  # distinct lengths only
    found = np.stack([counts.column("length").to_numpy(), counts.column("rows").to_numpy()], axis=1) if counts.num_rows else np.zeros((0, 2), np.int64)
    return found[np.argsort(found[:, 0])]


def _layer(best: np.ndarray, tops: np.ndarray, rows: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least padding of the first j lengths with one bucket more, and where its last bucket begins.

    Halves the range of j again and again; the choice for the middle one bounds those on both sides.
    """
    n = len(tops)
    now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    now[0] = best[0]
    lo, hi, left, right = (np.array([v], np.int64) for v in (1, n, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        last = np.minimum(right, mid - 1)
        sizes = last - left + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        of = np.repeat(np.arange(len(mid)), sizes)
        i = np.arange(sizes.sum()) - starts[of] + left[of]
        j = mid[of]
        cost = best[i] + tops[j - 1] * (rows[j] - rows[i]) - (total[j] - total[i])
        least = np.minimum.reduceat(cost, starts)
        first = np.full(len(mid), n, np.int64)
        at = np.flatnonzero(cost == least[of])[::-1]
        first[of[at]] = i[at]
        now[mid], cut[mid] = least, first
        under, over = lo < mid, mid < hi
        lo, hi, left, right = (
            np.concatenate([lo[under], mid[over] + 1]), np.concatenate([mid[under] - 1, hi[over]]),
            np.concatenate([left[under], first[over]]), np.concatenate([first[under], right[over]]),
        )
    return now, cut


def optimal_bounds(bins: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding."""
    if not len(bins):
        return []
    tops = bins[:, 0].astype(np.float64)
    rows = np.concatenate([[0.0], np.cumsum(bins[:, 1], dtype=np.float64)])
    total = np.concatenate([[0.0], np.cumsum(tops * bins[:, 1])])
    n = len(bins)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choice: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        best, cut = _layer(best, tops, rows, total)
        choice.append(cut)
    bounds, j = [], n
    for cut in reversed(choice):
        if j == 0:
            break
        bounds.append(int(tops[j - 1]))
        j = int(cut[j])
    return sorted(set(bounds))


def pack(
    docs: DataFrame,
    length: Column,
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    keep: tuple[str, ...] = (),
    spread: Column | None = None,
) -> DataFrame:
    """(doc_id, length, bucket, bucket_len, batch_id, slot, *keep) of every row."""
    place = F.xxhash64(F.col(doc_id).cast("long"), F.lit(0) if spread is None else spread)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), length.cast("long").alias("length"), place.alias("place_key"), *keep)
    rows = Scratch(docs.sparkSession, "packing").save(rows, "lengths")
    bins = histogram(rows.select("length"))
    bounds = optimal_bounds(bins, buckets) or [0]
    n = int(bins[:, 1].sum())
    shards = min(MOST_SHARDS, max(64, -(-n // SHARD_ROWS)))
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("length") <= bounds[i], F.lit(i)).otherwise(bucket)
    width = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    dealt = rows.withColumn("bucket", bucket).withColumn(
        "shard", F.pmod("place_key", F.lit(shards)).cast("int")
    )
    # at most BUCKETS * MOST_SHARDS rows
    sizes = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("bucket", "shard").orderBy("doc_id", "place_key")
    placed = (
        dealt.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(starts), ["bucket", "shard"])
        .withColumn("place", F.col("start") + F.col("at"))
        .withColumn("bucket_len", width)
        .withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))))
    )
    return placed.select(
        "doc_id",
        "length",
        "bucket",
        "bucket_len",
        F.floor(F.col("place") / F.col("room")).alias("batch_id"),
        (F.col("place") % F.col("room")).cast("int").alias("slot"),
        *keep,
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_count(F.col("text")), spread=F.col("text"))
