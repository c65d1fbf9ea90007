"""Every registered query of the engine, and the SQL that an independent engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import bench_queries, index_queries, mart_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = index_queries.QUERIES | mart_queries.QUERIES | bench_queries.QUERIES
ORACLE: dict[str, str] = index_queries.ORACLE | mart_queries.ORACLE | bench_queries.ORACLE
