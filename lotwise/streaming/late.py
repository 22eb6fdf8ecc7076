"""Windows that wait for late rows, items that come late or out of order, retries, cadence: streams and their batch replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import monitor
from .queries import _folder, events_stream

#: Failed tries after which an item is left alone; undecided items that go on to the next window; ids that a state remembers.
MOST_FAILS, RETRIES, SEEN_KEPT = 6, 200, 500


def sealed_windows(rows: DataFrame, ts: str, by: str, width: str = "1 day", lag: str = "30 minutes") -> DataFrame:
    """Counts of each window once it ends `lag` before the newest row: a window is given once, and late rows are still in it."""
    kept = rows.withWatermark(ts, lag).groupBy(F.window(ts, width), by).agg(F.count("*").alias("cnt"))
    return kept.select(F.col("window.start").alias("begins"), by, "cnt")


def anchored_weeks(rows: DataFrame, ts: str, end: Column, weeks: int) -> DataFrame:
    """Weeks counted back from `end` (1 is the last): rows, days with any, and rows a day; weeks without rows are not given."""
    age = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    week = (F.floor((age - 1) / (7 * 86_400_000_000)) + 1).alias("week")
    kept = rows.withColumn("_age", age).filter((F.col("_age") > 0) & (F.col("_age") <= weeks * 7 * 86_400_000_000)).withColumn("week", week)
    sums = kept.groupBy("week").agg(F.count("*").alias("cnt"), F.count_distinct(F.to_date(ts)).alias("days"))
    return sums.withColumn("per_day", F.floor(F.col("cnt") / 7 * 10 + 0.5) / 10)


def lagged_feed(rows: DataFrame, by: str, ts: str, now: Column, lag_days: int = 3) -> DataFrame:
    """Of each feed the rows of the week that ended lag_days ago, and a week's mean over the four weeks before it."""
    end = F.date_sub(F.to_date(now), lag_days)
    day = F.to_date(ts)
    sums = rows.groupBy(by).agg(
        F.count_if((day >= F.date_sub(end, 7)) & (day < end)).alias("week"), F.count_if((day >= F.date_sub(end, 35)) & (day < F.date_sub(end, 7))).alias("before")
    )
    return sums.select(by, "week", (F.col("before") / 4).alias("mean_before"))


def fresh_items(items: DataFrame, seen: DataFrame, fails: DataFrame, floor: int) -> DataFrame:
    """Items (id) to fetch, oldest first in line: above the floor, not seen, and not failed MOST_FAILS times.

    An item with a lower id than its neighbours that turns up later is fresh as well; a high-water mark would lose it.
    """
    given_up = fails.filter(F.col("fails") >= MOST_FAILS).select("id")
    return items.filter(F.col("id") > floor).join(seen.select("id"), "id", "left_anti").join(given_up, "id", "left_anti")


def advanced_seen(seen: DataFrame, done: DataFrame, kept: int = SEEN_KEPT) -> DataFrame:
    """The ids that the state remembers after `done`: the highest `kept`. The floor is the least of them once any were dropped."""
    return seen.select("id").union(done.select("id")).distinct().orderBy(F.desc("id")).limit(kept)


def with_retries(window: DataFrame, undecided: DataFrame, key: str, order: str, most: int = RETRIES) -> DataFrame:
    """The rows of a window and the oldest `most` undecided ones of earlier windows, each once; what is beyond waits for its turn."""
    again = undecided.join(window.select(key), key, "left_anti").orderBy(order, key).limit(most)
    return window.withColumn("retry", F.lit(False)).unionByName(again.withColumn("retry", F.lit(True)))


def due(jobs: DataFrame, now: Column, slack_seconds: int = 60) -> DataFrame:
    """Jobs (every_minutes, last) whose cadence has passed since their last run, but for some slack, and those that never ran."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("last")
    return jobs.filter(F.col("every_minutes").isNull() | F.col("last").isNull() | (waited >= F.col("every_minutes") * 60 - slack_seconds))


def running_totals(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Of each source its first and last row's time and how many there are, kept up to date as pages arrive."""
    return rows.groupBy(by).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("cnt"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_end(sealed_windows(events_stream(spark, sf_dir), "ts", "event_type"), "append", _folder(spark))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_to_end(running_totals(events_stream(spark, sf_dir), "event_type", "ts"), "complete", _folder(spark))


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    fails = orders.filter("id % 7 = 0").select("id", (F.col("id") % 9).alias("fails"))
    return fresh_items(orders, orders.filter("o_orderstatus = 'F'"), fails, 100)


def _retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "ts", "event_type")
    window, before = e.filter("ts >= '2024-01-20' and ts < '2024-01-22'"), e.filter("ts < '2024-01-20' and event_type = 'error'")
    return with_retries(window, before, "event_id", "ts").select("event_id", "retry")


def _due(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 300 * 10).alias("every_minutes"))
    return due(jobs.join(last, "user_id", "left"), F.lit("2024-01-28 12:00:00").cast("timestamp")).select("user_id")


QUERIES = {
    "st01_sealed_windows": _sealed,
    "st03_anchored_weeks": lambda spark, sf_dir: anchored_weeks(_events(spark, sf_dir), "ts", F.lit("2024-01-30 06:00:00"), 4),
    "st08_fresh_items": _fresh,
    "st08_advanced_seen": lambda spark, sf_dir: advanced_seen(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))),
    "st09_with_retries": _retries,
    "st10_lagged_feed": lambda spark, sf_dir: lagged_feed(_events(spark, sf_dir), "event_type", "ts", F.lit("2024-02-10")),
    "st12_due": _due,
    "st13_running_totals": _totals,
}

SQL = {
    "st01_sealed_windows": """WITH m AS (SELECT max(ts) - INTERVAL 30 MINUTE AS mark FROM events)
        SELECT date_trunc('day', ts)::TIMESTAMP AS begins, event_type, count(*) AS cnt FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL""",
    "st03_anchored_weeks": """WITH a AS (SELECT ts, epoch_us(TIMESTAMP '2024-01-30 06:00:00') - epoch_us(ts) AS age FROM events)
        SELECT (age - 1) // 604800000000 + 1 AS week, count(*) AS cnt, count(DISTINCT CAST(ts AS DATE)) AS days, floor(count(*) / 7 * 10 + 0.5) / 10 AS per_day FROM a WHERE age > 0 AND age <= 4 * 604800000000 GROUP BY 1""",
    "st08_fresh_items": "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey > 100 AND o_orderstatus <> 'F' AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 9 >= 6)",
    "st08_advanced_seen": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0 ORDER BY 1 DESC LIMIT 500",
    "st09_with_retries": """SELECT event_id, false AS retry FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-22'
        UNION ALL (SELECT event_id, true FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_type = 'error' ORDER BY ts, event_id LIMIT 200)""",
    "st10_lagged_feed": """SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' AND CAST(ts AS DATE) < DATE '2024-02-07') AS week,
        count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-03' AND CAST(ts AS DATE) < DATE '2024-01-31') / 4 AS mean_before FROM events GROUP BY 1""",
    "st12_due": """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
        SELECT c_custkey AS user_id FROM customer LEFT JOIN l ON l.user_id = c_custkey WHERE c_custkey % 5 = 0 OR last IS NULL OR epoch(TIMESTAMP '2024-01-28 12:00:00') - floor(epoch(last)) >= c_custkey % 300 * 10 * 60 - 60""",
    "st13_running_totals": "SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS cnt FROM events GROUP BY 1",
}
