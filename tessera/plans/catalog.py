"""Registry of named queries over the driver tables and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the oracle (if any) is an
independent SQL statement over the same parquet tables.  Floating results are
rounded to 6 decimals on both sides so engine-specific last bits do not count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def register(name: str, operators: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        OPERATORS[name] = operators
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tessera.plans import (  # noqa: F401
        text_queries, split_queries, candidate_queries, metric_queries,
        batch_queries, cluster_queries, eval_queries, augment_queries, sentence_queries, similarity_queries, file_queries,
    )
