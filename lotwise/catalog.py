"""Every query of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import alerts, analytics, conversion, feeds, freshness, gates, health, identity, ledger, ledger_rows, matching, outcomes, pages, records, register_changes, registers, registry, reports, trends
from .sources import html_queries, paging_queries
from .sources import queries as sources
from .streaming import late, session_queries
from .streaming import queries as streaming

MODULES = (freshness, gates, analytics, ledger, trends, identity, alerts, matching, outcomes, records, registry, reports, pages, feeds, health, conversion, registers, register_changes, ledger_rows, sources, html_queries, paging_queries, streaming, late, session_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
