"""Sessions, sliding comparisons, outbox and probe over the driver's tables, run to the end of what is there."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import monitor, sessions
from .queries import _folder, events_stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.rhythm(_events(spark, sf_dir), "user_id", "ts")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the event stream by each user's rhythm of the month's first half."""
    known = sessions.rhythm(_events(spark, sf_dir).filter("ts < '2024-01-16'"), "user_id", "ts")
    return monitor.run_to_end(sessions.rhythm_sessions(events_stream(spark, sf_dir), known, "user_id", "ts"), "complete", _folder(spark))


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days against eight, of each kind of event, from two streams joined by the windows' ends; only closed windows come out."""
    window = lambda width: sessions.sliding(events_stream(spark, sf_dir), "event_type", "ts", width, "1 day", "1 hour")
    out = monitor.run_to_end(sessions.base_and_recent(window("8 days"), window("2 days"), "event_type", 8, 2), "append", _folder(spark))
    return out.filter(F.col("ends") < _last_day(spark, sf_dir))


def _last_day(spark: SparkSession, sf_dir: str):
    return F.lit(_events(spark, sf_dir).agg(F.date_trunc("day", F.max("ts"))).first()[0])


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent when the line breaks once: pending rows of the first run and those that changed since, each once."""
    folder = _folder(spark)
    box = sessions.Outbox(spark, f"{folder}/box")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    sent: list[str] = []

    def send(batch: DataFrame) -> bool:
        batch.write.parquet(f"{folder}/sent/{len(sent)}")
        sent.append("taken")
        return True

    box.merge(rows.filter("key % 3 <> 0"), "key")
    box.deliver("key", lambda batch: send(batch) if len(sent) < 2 else False, 4)
    box.merge(rows.filter("key % 3 = 0 or key % 3 = 1"), "key")
    box.deliver("key", send, 4)
    return spark.read.parquet(f"{folder}/sent/*")


def _records(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A file for each supplier's number, but for every eleventh; those of every seventh are not final."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(posixpath.join(root, f"{number}.json")) as f:
                    f.write(json.dumps({"state": "review" if number % 7 == 0 else "open", "title": name}).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    table(spark, sf_dir, "supplier").filter("s_suppkey % 11 <> 3").select("s_suppkey", "s_name").mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    _records(spark, sf_dir, f"{folder}/in")
    stream = sessions.probe(spark, f"{folder}/in", f"{folder}/state", pending="review", most="400")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{folder}/out").select("id", "state", "title")


QUERIES = {
    "st05_rhythm": _rhythm,
    "st05_rhythm_sessions": _sessions,
    "st04_base_and_recent": _sliding,
    "st11_outbox": _outbox,
    "s09_probe": _probe,
}

_GAPS = """g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS us FROM events {where}),
    m AS (SELECT user_id, list_sort(list(us / 3600000000.0::DOUBLE))[count(*) // 2 + 1] AS median, count(*) AS n FROM g WHERE us > 0 GROUP BY 1),
    h AS (SELECT DISTINCT e.user_id, CASE WHEN coalesce(n, 0) >= 2 THEN greatest(6.0, least(336.0, 2.5 * median)) ELSE 24.0 END AS hours FROM events e LEFT JOIN m ON m.user_id = e.user_id)"""
SQL = {
    "st05_rhythm": f"WITH {_GAPS.format(where='')} SELECT user_id, hours FROM h",
    "st05_rhythm_sessions": f"""WITH {_GAPS.format(where="WHERE ts < '2024-01-16'")}, e AS (SELECT events.user_id, epoch_us(ts) AS t, CAST(floor(hours * 3600) AS BIGINT) * 1000000 AS gap FROM events JOIN h ON h.user_id = events.user_id),
        n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= gap THEN 0 ELSE 1 END AS starts FROM e), r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM n)
        SELECT user_id, make_timestamp(min(t)) AS begins, make_timestamp(max(t) + any_value(gap)) AS ends, count(*) AS cnt FROM r GROUP BY user_id, run""",
    "st04_base_and_recent": """WITH e AS (SELECT event_type, CAST(ts AS TIMESTAMP) AS ts FROM events), d AS (SELECT max(date_trunc('day', ts)) AS last FROM e),
        w AS (SELECT DISTINCT event_type, CAST(date_trunc('day', ts) + to_days(CAST(k AS INT)) AS TIMESTAMP) AS ends FROM e, range(1, 3) r(k))
        SELECT w.event_type, ends, count(*) / 8.0::DOUBLE AS base, count(*) FILTER (WHERE ts >= ends - INTERVAL 2 DAY) / 2.0::DOUBLE AS recent, round((count(*) FILTER (WHERE ts >= ends - INTERVAL 2 DAY) / 2.0::DOUBLE) / (count(*) / 8.0::DOUBLE) - 1, 6) AS change
        FROM w JOIN e ON e.event_type = w.event_type AND ts < ends AND ts >= ends - INTERVAL 8 DAY, d WHERE ends < last GROUP BY w.event_type, ends""",
    "st11_outbox": "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders",
    "s09_probe": "SELECT s_suppkey AS id, 'open' AS state, s_name AS title FROM supplier WHERE s_suppkey % 11 <> 3 AND s_suppkey % 7 <> 0 AND s_suppkey > 0",
}
