"""Named queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is its DuckDB form, where there is one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ret_hybrid"](spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"tidepool.plans.{name}")


MODULES = ("q_search", "q_facts", "q_text", "q_logs", "q_questions", "q_custom", "q_more", "q_last", "q_extract", "q_answers", "q_store", "q_packets", "q_codecs", "q_streams", "q_govern", "q_fusion")
