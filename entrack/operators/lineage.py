"""Cutting the lineage of iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from entrack.sources.files import new_folder


def cut(df: DataFrame) -> DataFrame:
    """A copy of the rows in the shared folder, as Parquet.

    Unlike a checkpoint, what is read again has the size of its files, not the estimate of the plan that made it;
    estimates of joins are products, and over rounds of joins they would grow without end.
    """
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
