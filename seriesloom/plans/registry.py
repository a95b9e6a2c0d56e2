"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, detail_queries, history_queries, ledger_queries, operation_queries, publication_queries, reader_queries, report_queries, rerun_queries, series_queries, source_queries

FLAGSHIP = "heatmap_trailing"
ALL = series_queries.QUERIES | catalog_queries.QUERIES | report_queries.QUERIES | publication_queries.QUERIES | source_queries.QUERIES | ledger_queries.QUERIES | rerun_queries.QUERIES | operation_queries.QUERIES | history_queries.QUERIES | reader_queries.QUERIES | detail_queries.QUERIES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, (f, _) in ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in ALL.items() if sql}
