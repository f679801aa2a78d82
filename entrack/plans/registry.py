"""Registered queries of the reference operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entrack.plans import assignment, catalogue, evaluation, live, outlines, retrieval, sequences, spatial, stores, texts, validation

_MODULES = (retrieval, catalogue, sequences, evaluation, texts, spatial, validation, stores, assignment, live, outlines)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
