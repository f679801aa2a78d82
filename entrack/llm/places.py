"""Positions of rows in a global order, counted without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, partitions


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``place``, the position from 0 in the group by ``order`` (nulls first), and ``of``, the group's size.

    Rows are dealt by ranges of the order and numbered inside each range; ranges are then shifted by the sizes of those
    before, so a group with most of the rows is spread over many tasks. Rows that are alike in all of the order are
    dealt by where they stood, and any of their numberings is a right one.
    """
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(partitions(rows.sparkSession), group, *order, "_row").sortWithinPartitions(group, *order, "_row").drop("_row")
    dealt = scratch.save(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("of"))
    return dealt.join(starts, [group, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
