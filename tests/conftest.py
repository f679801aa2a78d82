"""One local session, and a comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
from collections.abc import Callable

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame, Row, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("ENTRACK_TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    from entrack.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"


def plain(value: object) -> object:
    """A value as both engines give it: floats to nine digits, arrays as tuples, times without a zone."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | np.bool_):
        return bool(value)
    if isinstance(value, int | np.integer):
        return int(value)
    if isinstance(value, float | np.floating | decimal.Decimal):
        return round(float(value), 9) + 0.0
    if isinstance(value, Row | dict):
        return tuple(plain(v) for v in (value.asDict().values() if isinstance(value, Row) else value.values()))
    if isinstance(value, list | tuple | np.ndarray):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_duckdb() -> Callable[[DataFrame, str, str], None]:
    def compare(df: DataFrame, sql: str, sf_dir: str) -> None:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        ran = con.execute(sql)
        names = [d[0] for d in ran.description]
        expected = sorted_rows(names, ran.fetchall())
        found = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
        assert sorted(df.columns) == sorted(names)
        assert len(found) == len(expected)
        different = [(a, b) for a, b in zip(found, expected, strict=True) if a != b]
        assert not different, f"{len(different)} rows differ, first: {different[:2]}"

    return compare
