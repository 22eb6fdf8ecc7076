"""Streaming queries over the events table, run to the end of what is there; SQL says what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, table
from . import monitor, silence


def _folder(spark: SparkSession) -> str:
    return new_path(spark, "stream")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_end(monitor.windowed(events_stream(spark, sf_dir), "ts", "event_type"), "complete", _folder(spark))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = monitor.first_seen(events_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days")
    return monitor.run_to_end(once.select("user_id", "event_type"), "append", _folder(spark))


def observations(rows: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "purchase", "data").otherwise("empty")
    return rows.select(F.col("user_id").cast("string").alias("source"), F.col("ts").alias("at"), outcome.alias("outcome"))


def _silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silence.silence_stream(observations(events_stream(spark, sf_dir)), _folder(spark))


QUERIES = {"st02_tumbling_windows": _windows, "st14_first_seen": _seen, "st06_silence_monitor": _silence}
SQL = {
    "st02_tumbling_windows": """SELECT to_timestamp(floor(epoch(ts) / 259200) * 259200)::TIMESTAMP AS begins, to_timestamp(floor(epoch(ts) / 259200) * 259200 + 259200)::TIMESTAMP AS ends, event_type AS name, count(*) AS cnt
        FROM events GROUP BY ALL""",
    "st14_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}
