"""Registered queries: each applies operators to whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cell_queries, file_queries, pixel_queries, spatial_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (pixel_queries, cell_queries, spatial_queries, table_queries, file_queries)


def queries() -> dict[str, Query]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
