"""Queries over the given tables, by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 over the documents for passages of the benchmark, its ten best documents each."""
    load()
    return QUERIES["bm25_top10"](spark, sf_dir)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from sparkloom.plans import queries_graph, queries_more, queries_records, queries_rows, queries_search, queries_sources, queries_streams, queries_tables  # noqa: F401
