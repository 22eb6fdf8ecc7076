"""Freshness of sources: what arrived, and how lately."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def source_freshness(rows: DataFrame, source: str, collected: str, created: str, days: int = 7) -> DataFrame:
    """Rows by source: all, those of the last `days` before the newest row, and the newest of both times.

    The anchor is the newest `collected` of the table rather than the wall clock, so a replay gives the same rows.
    """
    now = rows.agg(F.max(collected).alias("now"))
    return (
        rows.crossJoin(F.broadcast(now))  # one row
        .groupBy(F.col(source).alias("source"))
        .agg(
            F.count("*").alias("cnt"),
            F.count_if(F.col(collected) > F.col("now") - F.expr(f"INTERVAL {days} DAYS")).alias("cnt_recent"),
            F.max(collected).alias("last_collected"),
            F.max(created).alias("last_created"),
        )
    )


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_freshness(table(spark, sf_dir, "events"), "event_type", "ts", "ts")


QUERIES = {"a01_source_freshness": _freshness}
SQL = {
    "a01_source_freshness": """
        SELECT event_type AS source, count(*) AS cnt,
               count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS cnt_recent,
               max(ts) AS last_collected, max(ts) AS last_created
        FROM events GROUP BY event_type""",
}
