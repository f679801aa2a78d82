"""Shared helpers: table access, scratch tables in the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every operator here counts them: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session in one process may do without: it gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="entrack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables, written as Parquet into the shared folder.

    Writing cuts the lineage: when an executor is lost, later steps read the table again and
    nothing upstream is computed twice. A table's shuffle files go once it is written. ``drop`` removes
    tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(_SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that a join gives to one task; at most MOST_HOT keys can have so many.
HOT_ROWS, MOST_HOT = 500, 50_000


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], salt_by: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """Join of ``many`` with ``one``, which has each key once and, in ``n``, how many rows of ``many`` have it.

    Rows of a frequent key are split by a hash of ``salt_by``, and its row of ``one`` is repeated for each part.
    A key is frequent from max(HOT_ROWS, total / MOST_HOT) rows on, so at most MOST_HOT keys are broadcast.
    ``how`` is inner or left. Columns: the keys, those of ``many``, those of ``one`` without n.
    """
    bound = max(HOT_ROWS, total // MOST_HOT)
    salts = F.ceil(F.col(n) / F.lit(bound)).cast("int")
    hot = one.where(F.col(n) > bound).select(*keys, salts.alias("salts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("salt", F.pmod(F.xxhash64(*salt_by), F.coalesce("salts", F.lit(1)).cast("long"))).drop("salts")
    last = F.when(F.col(n) > bound, salts.cast("long") - 1).otherwise(F.lit(0).cast("long"))
    spread = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(n)
    return dealt.join(spread, [*keys, "salt"], how).drop("salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value's decimal text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
