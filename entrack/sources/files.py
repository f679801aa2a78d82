"""Stores in folders: replace-all, append with resume, partition delete, JSON lines, vector files."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that spark.checkpoint.dir names; only a local session may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="entrack-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def version_parts(version: str) -> list[tuple[int, int, str]]:
    """A version as numbers and texts between them, so that v10 comes after v9."""
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", version)]


class Store:
    """Versions of a table under one folder; one small file names the version that is the store.

    A version is written whole into a folder of its own, and then the pointer is renamed into place, so readers see
    the old rows or the new ones, and a write that broke off changes nothing. ``version`` gates a replacement: only a
    newer one is written. The folder of the version before stays until the next commit, for those who still read it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _pointers(self) -> list[int]:
        if not self.files.exists(self._path("current")):
            return []
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(self._path("current")) if s.getPath().getName().isdigit())

    def _pointed(self, number: int) -> tuple[str, str]:
        """The version and the folder that a pointer names."""
        stream = self.files.open(self._path(f"current/{number}"))
        try:
            version, folder = str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
        finally:
            stream.close()
        return version, folder

    def version(self) -> str | None:
        found = self._pointers()
        return self._pointed(found[-1])[0] if found else None

    def write(self, rows: DataFrame) -> str:
        """Writes rows into a folder that no pointer names yet."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, version: str, folder: str) -> bool:
        """Makes the folder the store. Of two commits at once one gets the next number; the other says false."""
        before = self._pointers()
        number = before[-1] + 1 if before else 0
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        out = self.files.create(draft)
        out.write(bytearray(f"{version}\n{folder}".encode()))
        out.close()
        self.files.mkdirs(self._path("current"))
        done = not self.files.exists(self._path(f"current/{number}")) and self.files.rename(draft, self._path(f"current/{number}"))
        if not done:
            self.files.delete(draft, False)
            return False
        for old in before[:-1]:
            self.files.delete(self._path(self._pointed(old)[1]), True)
            self.files.delete(self._path(f"current/{old}"), False)
        return True

    def replace(self, rows: DataFrame, version: str) -> bool:
        """Replaces all rows, unless the store's version is not older."""
        now = self.version()
        if now is not None and version_parts(now) >= version_parts(version):
            return False
        return self.commit(version, self.write(rows))

    def seed(self, rows: DataFrame, version: str) -> bool:
        """Writes rows only where the store has none."""
        return self.version() is None and self.replace(rows, version)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._pointed(self._pointers()[-1])[1]}")

    def delete(self, gone: Column) -> None:
        """Removes the rows for which ``gone`` holds; the version stays. Null says no."""
        rows = self.read().where(~F.coalesce(gone, F.lit(False)))
        self.commit(self.version(), self.write(rows))

    def delete_prefix(self, column: str, prefix: str) -> None:
        self.delete(key_range(F.col(column), prefix))


def migrate(old: Store, new: Store, key: str, moved: Column) -> None:
    """Moves the rows for which ``moved`` holds: those whose key the new store lacks are added, then all go from the old one.

    The copy is committed before anything is deleted, so a run that breaks off is made good by the next one.
    """
    rows = old.read().where(moved)
    if new.version() is None:
        new.seed(rows, old.version())
    else:
        have = new.read()
        new.commit(new.version(), new.write(have.unionByName(rows.join(have.select(key), key, "left_anti"))))
    old.delete(moved)


def keep_partitions(spark: SparkSession, path: str, column: str, kept: list[object]) -> DataFrame:
    """The partitions of a folder that stay, pruned by the scan."""
    return spark.read.parquet(path).where(F.col(column).isin(*kept))


def replace_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Overwrites the partitions that ``rows`` has and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a torn line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_missing(rows: DataFrame, path: str, key: str, schema: str, order: list[str]) -> None:
    """Appends rows whose key the JSON lines at ``path`` do not have yet, the first one of each key."""
    spark = rows.sparkSession
    firsts = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    done = read_lines(spark, path, schema).select(key)
    firsts.join(done, key, "left_anti").write.mode("append").json(path)


def key_range(column: Column, prefix: str) -> Column:
    """Keys that begin with the prefix, as a range that a scan can skip files by."""
    return (column >= prefix) & (column < prefix[:-1] + chr(ord(prefix[-1]) + 1))


#: A vector file's head: magic, version, dimension, count, bytes a component; little endian.
MAGIC, VERSION = b"EVEC", 1
_HEAD = np.dtype([("magic", "S4"), ("version", "<u4"), ("dim", "<u4"), ("count", "<u4"), ("width", "<u4")])


def encoded(vectors: DataFrame, group: str, order: str) -> DataFrame:
    """(group, file): one vector file for each group, int8 components in order. Groups are bounded parts of an index."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        body = np.stack(rows["vec"].to_list()).astype(np.int8)
        head = np.array([(MAGIC, VERSION, body.shape[1], body.shape[0], 1)], _HEAD)
        return pd.DataFrame({group: [rows[group].iloc[0]], "file": [head.tobytes() + body.tobytes()]})

    return vectors.groupBy(group).applyInPandas(pack, f"{group} long, file binary")


def decoded(files: DataFrame, group: str, dim: int) -> DataFrame:
    """(group, pos, vec, fault): the vectors of each file, or one row with what is wrong with it."""

    def unpack(batches):
        for batch in batches:
            for key, data in zip(batch[group], batch["file"], strict=True):
                head = np.frombuffer(data[: _HEAD.itemsize], _HEAD)[0] if len(data) >= _HEAD.itemsize else None
                fault = None
                if head is None or head["magic"] != MAGIC:
                    fault = "not a vector file"
                elif head["version"] != VERSION:
                    fault = "unknown version"
                elif head["dim"] != dim:
                    fault = "wrong dimension"
                elif len(data) != _HEAD.itemsize + int(head["dim"]) * int(head["count"]) * int(head["width"]):
                    fault = "wrong length"
                if fault:
                    yield pd.DataFrame({group: [key], "pos": [-1], "vec": [None], "fault": [fault]})
                    continue
                body = np.frombuffer(data, np.int8, offset=_HEAD.itemsize).reshape(-1, dim).astype(np.int32)
                yield pd.DataFrame({group: key, "pos": np.arange(len(body)), "vec": list(body), "fault": None})

    return files.mapInPandas(unpack, f"{group} long, pos long, vec array<int>, fault string")
