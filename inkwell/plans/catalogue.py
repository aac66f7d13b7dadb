"""All registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where SQL can express it."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return register


def load() -> None:
    """Import every module that registers queries."""
    from inkwell.plans import amount_queries, assembly_queries, contract_queries, decode_queries, join_queries, key_queries, metric_queries, more_queries, release_queries, rollup_queries, text_queries, value_queries, vocab_queries  # noqa: F401
