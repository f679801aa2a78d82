"""Every registered query of the reference operators against its DuckDB equivalent, over whole tables."""

from __future__ import annotations

import pytest

from entrack.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_duckdb(spark, small, same_as_duckdb, name):
    same_as_duckdb(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_with_a_stable_schema(spark, small, name):
    first = registry.QUERIES[name](spark, small)
    assert first.schema == registry.QUERIES[name](spark, small).schema
    assert len(set(first.columns)) == len(first.columns)
    assert first.count() > 0
