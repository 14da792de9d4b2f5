"""All registered queries in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintfleet.fixtures import catalog_queries, lint_queries, report_queries, resolve_queries, script_queries, selection_queries

_MODULES = [catalog_queries, script_queries, lint_queries, selection_queries, resolve_queries, report_queries]
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["D00_audit_driver"](spark, sf_dir)
