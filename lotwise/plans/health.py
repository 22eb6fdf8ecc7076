"""Health of the crawl: freshness ladders, dead and stale sources, coverage of runs, decision logs and their percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..views import TENDERS, anchored, money, tenders


def hours_since(now: str, then: str):
    return (F.unix_timestamp(F.col(now).cast("timestamp")) - F.unix_timestamp(F.col(then).cast("timestamp"))) / 3600.0


def freshness_ladder(rows: DataFrame, by: str, ts: str, ok_hours: float = 4, warn_hours: float = 8) -> DataFrame:
    """ok, warn or fail by the age of each group's newest row against the table's newest."""
    newest = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(F.max(ts).alias("last"), F.max("now").alias("now"))
    age = hours_since("now", "last")
    return newest.select("name", "last", F.when(age < ok_hours, "ok").when(age < warn_hours, "warn").otherwise("fail").alias("status"))


def dead_sources(expected: DataFrame, rows: DataFrame, by: str, ts: str, days: int, excused: list[str]) -> DataFrame:
    """Expected sources, less the excused, without a row in the last days; one that never had a row is dead too."""
    last = anchored(rows, ts).filter(F.col(ts) > F.col("now") - F.expr(f"INTERVAL {days} DAYS")).select(F.col(by).alias("name")).distinct()
    return expected.filter(~F.col("name").isin(*excused)).join(last, "name", "left_anti")


def low_sources(rows: DataFrame, by: str, ts: str, days: int, least: int) -> DataFrame:
    """Sources that are alive in the last days, but with fewer than `least` rows."""
    recent = anchored(rows, ts).filter(F.col(ts) > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("cnt")).filter(F.col("cnt") < least)


def heavy_and_stale(rows: DataFrame, by: str, ts: str, heavy: float, hours: float) -> DataFrame:
    """Sources with at least `heavy` percent of all rows that have been quiet for longer than `hours`, and their summed share."""
    g = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(F.count("*").alias("cnt"), F.max(ts).alias("last"), F.max("now").alias("now"))
    g = g.withColumn("share", F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy(F.lit(1))))  # over sources
    stale = g.filter((F.col("share") >= heavy) & (hours_since("now", "last") > hours))
    return stale.select("name", F.round("share", 4).alias("share"), F.round(F.sum("share").over(Window.partitionBy(F.lit(1))), 4).alias("all_share"))


def run_coverage(runs: DataFrame, expected: list[str], tolerance: int) -> DataFrame:
    """runs (run, source rows): whether a run was full: at most `tolerance` expected sources missing and as many unexpected."""
    want = F.array(*map(F.lit, expected))
    seen = runs.groupBy("run").agg(F.sort_array(F.collect_set("source")).alias("seen"))
    missing, extra = F.array_except(want, F.col("seen")), F.array_except(F.col("seen"), want)
    return seen.select("run", F.array_join(F.sort_array(missing), ",").alias("missing"), F.size(extra).alias("extra"), ((F.size(missing) <= tolerance) & (F.size(extra) <= tolerance)).alias("full"))


def run_stats(runs: DataFrame) -> DataFrame:
    """runs (source, seconds, failed): success, mean and largest duration of those within two hours."""
    sane = F.col("seconds").between(0, 7200)
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.round(F.avg((~F.col("failed")).cast("int")) * 100, 2).alias("success"), F.round(F.avg(F.when(sane, F.col("seconds"))), 4).alias("mean_seconds"), F.max(F.when(sane, F.col("seconds"))).alias("longest")
    )


def model_comparison(log: DataFrame) -> DataFrame:
    """log (model, role, accepted, error, ms): calls, errors, acceptance and the value at index floor(n * 0.95) of the times.

    Times are counted by value before they are put in order, so a model with most calls is no list in one task.
    """
    keys = ["model", "role"]
    base = log.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("error") != "").alias("errors"), F.count_if("accepted").alias("accepted"))
    n = log.groupBy(*keys, "ms").agg(F.count("*").alias("c"))
    up = n.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("ms"))).withColumn("all", F.sum("c").over(Window.partitionBy(*keys)))
    index = F.least(F.floor(F.col("all") * 0.95), F.col("all") - 1)
    return base.join(up.filter(F.col("upto") > index).groupBy(*keys).agg(F.min("ms").alias("p95")), keys)


def daily_rollup(rows: DataFrame, ts: str, by: str, value: str) -> DataFrame:
    """Mean, extremes and number by day and source."""
    return rows.groupBy(F.to_date(ts).alias("day"), F.col(by).alias("name")).agg((F.sum(money(value)).cast("double") / F.count(value)).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("samples"))


def deadline_semantics(rows: DataFrame) -> DataFrame:
    """By source: rows, deadlines that are still ahead at collection, and whether the field looks like something else."""
    ahead = F.col("deadline") > F.to_date("collected_at")
    g = rows.groupBy("source").agg(F.count("*").alias("cnt"), F.count("deadline").alias("parsed"), F.count_if(ahead).alias("future"), F.max(F.datediff("deadline", F.to_date("collected_at"))).alias("max_lead"))
    return g.withColumn("suspect", (F.col("parsed") >= 8) & (F.col("future") < 0.03 * F.col("parsed")))


def persistent(rows: DataFrame, by: str, week: str, weeks: int) -> DataFrame:
    """Groups that are there in each of the last `weeks` weeks."""
    last = rows.select(F.col(week).alias("w")).distinct().orderBy(F.desc("w")).limit(weeks)
    return rows.select(F.col(by).alias("name"), F.col(week).alias("w")).distinct().join(F.broadcast(last), "w").groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == weeks).select("name")


def impact(rows: DataFrame) -> DataFrame:
    """One row over all lots: organisations, regions, priced share, and the price's quartiles by nearest rank."""
    n = rows.filter("price > 0").groupBy("price").agg(F.count("*").alias("c"))
    up = n.withColumn("slot", F.floor(F.log10("price")))
    # Running counts by order of magnitude first, so no task orders all prices.
    before = up.groupBy("slot").agg(F.sum("c").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = up.join(before, "slot").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("slot").orderBy("price")))
    total = rows.agg(F.count("*").alias("lots"), F.count_if(F.col("price") > 0).alias("priced"), F.count_distinct("organization").alias("organizations"))
    rank = lambda p: F.bround(F.lit(p) * (F.col("priced") - 1), 0)
    quart = ranked.crossJoin(F.broadcast(total)).agg(*[F.min(F.when(F.col("upto") > rank(p), F.col("price"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return total.crossJoin(F.broadcast(quart))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.to_date("ts").alias("run"), F.concat(F.lit("s"), F.col("user_id") % 40).alias("source"), (F.col("value") * 40).alias("seconds"), (F.col("event_type") == "error").alias("failed"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("role"), (F.col("value") > 20).alias("accepted"), F.when(F.col("event_id") % 13 == 0, "429").otherwise("").alias("error"), F.floor(F.col("value") * 10).alias("ms"))


def _deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenders(spark, sf_dir)
    shift = F.when(F.col("source") == "BUILDING", -2).otherwise((F.col("id") % 30).cast("int"))
    return deadline_semantics(rows.withColumn("deadline", F.when(F.col("id") % 5 != 0, F.date_add(F.to_date("collected_at"), shift))))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value > 60 or ts < timestamp_ntz'2024-01-15'")
    expected = spark.range(0, 170).select(F.col("id").alias("name"))
    return dead_sources(expected, events, "user_id", "ts", 7, [15, 160])


def _persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_type = 'error' and value > 30")
    return persistent(events.withColumn("week", F.to_date(F.date_trunc("week", "ts"))), "user_id", "week", 3)


QUERIES = {
    "a60_freshness_ladder": lambda spark, sf_dir: freshness_ladder(table(spark, sf_dir, "events"), "user_id", "ts"),
    "a61_run_coverage": lambda spark, sf_dir: run_coverage(_runs(spark, sf_dir), [f"s{k}" for k in range(0, 41)], 1),
    "a39_run_stats": lambda spark, sf_dir: run_stats(_runs(spark, sf_dir)),
    "a33_model_comparison": lambda spark, sf_dir: model_comparison(_log(spark, sf_dir)),
    "a57_daily_rollup": lambda spark, sf_dir: daily_rollup(table(spark, sf_dir, "events"), "ts", "event_type", "value"),
    "a63_low_sources": lambda spark, sf_dir: low_sources(table(spark, sf_dir, "events"), "user_id", "ts", 7, 12),
    "a66_heavy_and_stale": lambda spark, sf_dir: heavy_and_stale(table(spark, sf_dir, "events"), "user_id", "ts", 0.6, 6),
    "a68_dead_sources": _dead,
    "a69_deadline_semantics": _deadlines,
    "a36_persistent": _persistent,
    "a38_impact": lambda spark, sf_dir: impact(tenders(spark, sf_dir)),
}

_AGE = "(epoch(date_trunc('second', n.t)) - epoch(date_trunc('second', max(ts)))) / 3600.0"
_LOG = """l AS (SELECT 'm' || user_id % 3 AS model, event_type AS role, value > 20 AS accepted, event_id % 13 = 0 AS error, CAST(floor(value * 10) AS BIGINT) AS ms FROM events)"""

SQL = {
    "a60_freshness_ladder": f"""WITH n AS (SELECT max(ts) AS t FROM events), g AS (SELECT user_id AS name, max(ts) AS last, {_AGE} AS age FROM events, n GROUP BY user_id, n.t)
        SELECT name, last, CASE WHEN age < 4 THEN 'ok' WHEN age < 8 THEN 'warn' ELSE 'fail' END AS status FROM g""",
    "a61_run_coverage": """WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS run, 's' || user_id % 40 AS source FROM events), e AS (SELECT 's' || range AS source FROM range(0, 41)), d AS (SELECT DISTINCT run FROM r),
        m AS (SELECT d.run, string_agg(e.source, ',' ORDER BY e.source) AS missing, count(*) AS n FROM d, e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.run = d.run AND r.source = e.source) GROUP BY 1)
        SELECT d.run, coalesce(missing, '') AS missing, 0 AS extra, coalesce(n, 0) <= 1 AS "full" FROM d LEFT JOIN m ON m.run = d.run""",
    "a39_run_stats": """WITH r AS (SELECT 's' || user_id % 40 AS source, value * 40 AS seconds, event_type = 'error' AS failed FROM events)
        SELECT source, count(*) AS runs, round(avg((NOT failed)::INT) * 100, 2) AS success, round(avg(seconds) FILTER (WHERE seconds BETWEEN 0 AND 7200), 4) AS mean_seconds, max(seconds) FILTER (WHERE seconds BETWEEN 0 AND 7200) AS longest FROM r GROUP BY 1""",
    "a33_model_comparison": f"""WITH {_LOG}, g AS (SELECT model, role, count(*) AS calls, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE accepted) AS accepted, list_sort(list(ms)) AS v FROM l GROUP BY ALL)
        SELECT model, role, calls, errors, accepted, v[CAST(least(floor(len(v) * 0.95::DOUBLE), len(v) - 1) AS INTEGER) + 1] AS p95 FROM g""",
    "a57_daily_rollup": "SELECT CAST(ts AS DATE) AS day, event_type AS name, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) / count(value) AS mean, min(value) AS least, max(value) AS most, count(*) AS samples FROM events GROUP BY ALL",
    "a63_low_sources": "WITH n AS (SELECT max(ts) AS t FROM events) SELECT user_id AS name, count(*) AS cnt FROM events, n WHERE ts > t - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) < 12",
    "a66_heavy_and_stale": f"""WITH n AS (SELECT max(ts) AS t FROM events), g AS (SELECT user_id AS name, count(*) AS cnt, {_AGE} AS age FROM events, n GROUP BY user_id, n.t), s AS (SELECT name, age, cnt * 100.0::DOUBLE / sum(cnt) OVER () AS share FROM g)
        SELECT name, round(share, 4) AS share, round(sum(share) OVER (), 4) AS all_share FROM s WHERE share >= 0.6 AND age > 6""",
    "a68_dead_sources": """WITH e AS (SELECT * FROM events WHERE value > 60 OR ts < TIMESTAMP '2024-01-15'), n AS (SELECT max(ts) AS t FROM e)
        SELECT range AS name FROM range(0, 170) WHERE range NOT IN (15, 160) AND range NOT IN (SELECT user_id FROM e, n WHERE ts > t - INTERVAL 7 DAY)""",
    "a69_deadline_semantics": f"""WITH {TENDERS}, d AS (SELECT source, CAST(collected_at AS DATE) AS c, CASE WHEN id % 5 <> 0 THEN CAST(collected_at AS DATE) + CASE WHEN source = 'BUILDING' THEN -2 ELSE CAST(id % 30 AS INTEGER) END END AS deadline FROM tenders),
        g AS (SELECT source, count(*) AS cnt, count(deadline) AS parsed, count(*) FILTER (WHERE deadline > c) AS future, CAST(max(deadline - c) AS INTEGER) AS max_lead FROM d GROUP BY 1)
        SELECT *, parsed >= 8 AND future < 0.03 * parsed AS suspect FROM g""",
    "a36_persistent": """WITH e AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS w FROM events WHERE event_type = 'error' AND value > 30), l AS (SELECT DISTINCT w FROM e ORDER BY w DESC LIMIT 3)
        SELECT user_id AS name FROM e WHERE w IN (SELECT w FROM l) GROUP BY 1 HAVING count(*) = 3""",
    "a38_impact": f"""WITH {TENDERS}, v AS (SELECT list_sort(list(price)) AS p FROM tenders WHERE price > 0)
        SELECT (SELECT count(*) FROM tenders) AS lots, (SELECT count(*) FROM tenders WHERE price > 0) AS priced, (SELECT count(DISTINCT organization) FROM tenders) AS organizations,
               p[CAST(round_even(0.25::DOUBLE * (len(p) - 1), 0) AS INTEGER) + 1] AS q25, p[CAST(round_even(0.5::DOUBLE * (len(p) - 1), 0) AS INTEGER) + 1] AS q50, p[CAST(round_even(0.75::DOUBLE * (len(p) - 1), 0) AS INTEGER) + 1] AS q75 FROM v""",
}
