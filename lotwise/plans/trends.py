"""Windows over time: base against recent, weekly buckets, rhythm, streaks, percentiles, nearest snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from ..views import anchored


def drop_pct(base: Column, recent: Column) -> Column:
    """How far recent fell below base, in percent; null without a base."""
    return F.when(base > 0, F.round((base - recent) / base * 100, 1))


def base_and_recent(rows: DataFrame, by: str, ts: str, base_days: int = 14, recent_days: int = 7) -> DataFrame:
    """Rows a day in the last `recent_days` and in the `base_days` before, by group, and the drop."""
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    recent = F.count_if(age < recent_days * 86400)
    base = F.count_if((age >= recent_days * 86400) & (age < (recent_days + base_days) * 86400))
    out = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(base.alias("base"), recent.alias("recent"))
    a, b = F.col("base") / base_days, F.col("recent") / recent_days
    return out.select("name", "base", "recent", F.round(a, 4).alias("base_per_day"), F.round(b, 4).alias("recent_per_day"), drop_pct(a, b).alias("drop"))


def weekly_buckets(rows: DataFrame, ts: str, weeks: int = 4) -> DataFrame:
    """Seven-day buckets counted back from the newest row; bucket 0 is the newest."""
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    out = anchored(rows, ts).withColumn("bucket", F.floor(age / (7 * 86400))).filter(F.col("bucket") < weeks)
    return out.groupBy("bucket").agg(F.count("*").alias("cnt"), F.count_distinct(F.to_date(ts)).alias("days")).withColumn("per_day", F.round(F.col("cnt") / 7.0, 1))


def slide(rows: DataFrame, ts: str, weeks: int = 4, steps: int = 3, least_drop: float = 30.0) -> DataFrame:
    """One row: whether the last `steps` full buckets each fell, by at least `least_drop` percent in all."""
    full = weekly_buckets(rows, ts, weeks).filter("days >= 5")
    tail = Window.partitionBy(F.lit(1)).orderBy("bucket")  # at most `weeks` rows
    last = full.withColumn("k", F.row_number().over(tail)).filter(F.col("k") <= steps + 1).withColumn("older", F.lead("per_day").over(tail))
    falls = F.coalesce(F.bool_and(F.col("per_day") < F.col("older")), F.lit(False))
    total = drop_pct(F.max_by("per_day", "bucket"), F.min_by("per_day", "bucket"))
    return last.agg(F.count("*").alias("buckets"), falls.alias("monotone"), total.alias("drop")).withColumn(
        "slides", (F.col("buckets") == steps + 1) & F.col("monotone") & F.coalesce(F.col("drop") >= least_drop, F.lit(False))
    )


def silent(rows: DataFrame, by: str, ts: str, recent_days: int, least: int = 10) -> DataFrame:
    """Groups with at least `least` rows before the last `recent_days` and none within."""
    recent = F.col(ts) > F.col("now") - F.expr(f"INTERVAL {recent_days} DAYS")
    out = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(F.count_if(~recent).alias("was"), F.count_if(recent).alias("recent"))
    return out.filter((F.col("recent") == 0) & (F.col("was") >= least)).select("name", "was")


def rhythm(rows: DataFrame, by: str, ts: str, keep: int = 5, least: int = 2, factor: float = 2.5, low: float = 6.0, high: float = 336.0) -> DataFrame:
    """Each group's typical gap in hours (upper median of its last `keep` gaps) and how long a silence it is allowed."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    order = Window.partitionBy(by).orderBy(ts)
    gaps = rows.select(F.col(by), F.col(ts), F.round((seconds - F.lag(seconds).over(order)) / 3600, 2).alias("gap")).filter("gap > 0")
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts)))
    last = gaps.withColumn("k", back).filter(F.col("k") <= keep).groupBy(F.col(by).alias("name")).agg(F.sort_array(F.collect_list("gap")).alias("gaps"))
    typical = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))
    allowed = F.greatest(F.lit(low), F.least(F.lit(high), typical * factor))
    return last.select("name", F.size("gaps").alias("n"), typical.alias("typical"), F.when(F.size("gaps") >= least, F.round(allowed, 4)).alias("allowed"))


def zero_streaks(rows: DataFrame, by: str, order: str, empty: Column) -> DataFrame:
    """Longest and current run of empty observations of each group: gaps and islands."""
    w = Window.partitionBy(by).orderBy(order)
    islands = rows.select(F.col(by).alias("name"), F.col(order).alias("t"), empty.alias("empty"), F.sum((~empty).cast("int")).over(w).alias("island"))
    runs = islands.groupBy("name", "island").agg(F.count_if("empty").alias("run"))
    return runs.groupBy("name").agg(F.max("run").alias("longest"), F.max_by("run", "island").alias("current"))


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile of a sorted array by nearest rank, round(p * (n - 1)) half to even; null for no values."""
    return F.get(values, F.bround(F.lit(p) * (F.size(values) - 1), 0).cast("int"))


def percentiles_by(rows: DataFrame, by: str, value: Column, ps: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Exact nearest-rank percentiles by group, from counts of distinct values rather than lists of all rows.

    Values are counted before the shuffle; a window adds the counts up, and the value whose range of ranks holds the
    wanted one is taken. So a group with most of the rows costs its distinct values, not its rows.
    """
    n = rows.select(F.col(by).alias("name"), value.alias("v")).filter("v is not null").groupBy("name", "v").agg(F.count("*").alias("c"))
    up = n.withColumn("upto", F.sum("c").over(Window.partitionBy("name").orderBy("v"))).withColumn("all", F.sum("c").over(Window.partitionBy("name")))
    rank = lambda p: F.bround(F.lit(p / 100.0) * (F.col("all") - 1), 0)
    return up.groupBy("name").agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") > rank(p), F.col("v"))).alias(f"p{p}") for p in ps])


def lead_buckets(rows: DataFrame, hours: Column) -> DataFrame:
    """Lots by the time left when they were first seen."""
    bucket = F.when(hours < 0, "closed").when(hours < 24, "under a day").when(hours < 72, "1-3 days").when(hours < 168, "3-7 days").otherwise("over a week")
    return rows.filter(hours.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: str, span_days: int) -> DataFrame:
    """As-of join: for each left row the right row of its key nearest in time within span_days (the earlier of two).

    Right rows are put into slots of the span; a left row meets its own and the two next slots, so the join is an equi-join.
    Left rows that repeat are looked up once, and each is given.
    """
    columns, left = left.columns, left.groupBy(*left.columns).agg(F.count("*").alias("_n"))
    slot = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (span_days * 86400))
    r = right.select(F.col(key).alias("rk"), F.col(when).alias("rt"), F.col(value).alias("rv"), slot(F.col(when)).alias("rs"))
    ids = left.withColumn("ls", F.explode(F.array(*[slot(F.col(at)) + d for d in (-1, 0, 1)])))
    joined = ids.join(r, (F.col(key) == F.col("rk")) & (F.col("ls") == F.col("rs")), "left")
    gap = F.abs(F.unix_micros(F.col("rt").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")))
    inside = gap <= span_days * 86400 * 1_000_000
    best = F.min_by(F.when(inside, F.col("rv")), F.when(inside, F.struct(gap, "rt", "rv")))
    found = joined.groupBy(*left.columns).agg(best.alias("nearest"))
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*columns, "nearest")


def week_over_week(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Rows by group and week, with the change to the week before."""
    weeks = rows.groupBy(F.col(by).alias("name"), F.to_date(F.date_trunc("week", ts)).alias("week")).agg(F.count("*").alias("cnt"))
    return weeks.withColumn("delta", F.col("cnt") - F.lag("cnt").over(Window.partitionBy("name").orderBy("week")))


def _e(f, *args, **kw):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "events"), *args, **kw)


def _errors(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value < 20 or ts < timestamp_ntz'2024-01-20'")


def _pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return nearest(left, events.filter("event_type = 'click'"), "user_id", "ts", "ts", "event_id", 2)


QUERIES = {
    "a26_base_and_recent": _e(base_and_recent, "event_type", "ts"),
    "a27_weekly_buckets": _e(weekly_buckets, "ts"),
    "a27_trend_slide": _e(slide, "ts"),
    "a28_silent_sources": lambda spark, sf_dir: silent(_errors(spark, sf_dir).withColumn("k", F.concat_ws("/", "user_id", "event_type")), "k", "ts", 10, 5),
    "a29_lead_buckets": lambda spark, sf_dir: lead_buckets(table(spark, sf_dir, "events"), F.col("value") - 20),
    "a29_percentiles": lambda spark, sf_dir: percentiles_by(table(spark, sf_dir, "events"), "event_type", F.col("value")),
    "a30_detection_lag": lambda spark, sf_dir: percentiles_by(table(spark, sf_dir, "events").filter("value >= 5"), "user_id", F.col("value"), (50, 90)),
    "w05_gap_rhythm": _e(rhythm, "user_id", "ts"),
    "w06_zero_streaks": lambda spark, sf_dir: zero_streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") < 30),
    "w09_week_over_week": _e(week_over_week, "event_type", "ts"),
    "j21_nearest_snapshot": _pairs,
}

_AGE = "epoch(n.t) - epoch(ts)"


def _rank(p: int) -> str:
    return f"vs[CAST(round_even({p / 100.0}::DOUBLE * (len(vs) - 1), 0) AS INTEGER) + 1]"


SQL = {
    "a26_base_and_recent": """WITH n AS (SELECT date_trunc('second', max(ts)) AS t FROM events), g AS (SELECT event_type AS name, count(*) FILTER (WHERE age >= 7 * 86400 AND age < 21 * 86400) AS base,
          count(*) FILTER (WHERE age < 7 * 86400) AS recent FROM (SELECT *, epoch(n.t) - epoch(date_trunc('second', ts)) AS age FROM events, n) GROUP BY 1)
        SELECT name, base, recent, round(base / 14::DOUBLE, 4) AS base_per_day, round(recent / 7::DOUBLE, 4) AS recent_per_day,
               CASE WHEN base > 0 THEN round((base / 14::DOUBLE - recent / 7::DOUBLE) / (base / 14::DOUBLE) * 100, 1) END AS drop FROM g""",
    "a27_weekly_buckets": """WITH n AS (SELECT max(ts) AS t FROM events), b AS (SELECT CAST(floor((epoch(date_trunc('second', n.t)) - epoch(date_trunc('second', ts))) / (7 * 86400)) AS BIGINT) AS bucket, ts FROM events, n)
        SELECT bucket, count(*) AS cnt, count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / 7.0::DOUBLE, 1) AS per_day FROM b WHERE bucket < 4 GROUP BY 1""",
    "a27_trend_slide": """WITH n AS (SELECT max(ts) AS t FROM events), b AS (SELECT CAST(floor((epoch(date_trunc('second', n.t)) - epoch(date_trunc('second', ts))) / (7 * 86400)) AS BIGINT) AS bucket, ts FROM events, n),
        w AS (SELECT bucket, round(count(*) / 7.0::DOUBLE, 1) AS per_day FROM b WHERE bucket < 4 GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 5),
        k AS (SELECT *, lead(per_day) OVER (ORDER BY bucket) AS older FROM w ORDER BY bucket LIMIT 4),
        s AS (SELECT count(*) AS buckets, coalesce(bool_and(per_day < older), false) AS monotone, round((arg_max(per_day, bucket) - arg_min(per_day, bucket)) / arg_max(per_day, bucket) * 100, 1) AS drop FROM k)
        SELECT *, buckets = 4 AND monotone AND drop >= 30 AS slides FROM s""",
    "a28_silent_sources": """WITH e AS (SELECT * FROM events WHERE value < 20 OR ts < TIMESTAMP '2024-01-20'), n AS (SELECT max(ts) AS t FROM e)
        SELECT user_id || '/' || event_type AS name, count(*) AS was FROM e, n GROUP BY 1 HAVING count(*) FILTER (WHERE ts > t - INTERVAL 10 DAY) = 0 AND count(*) >= 5""",
    "a29_lead_buckets": """SELECT CASE WHEN value - 20 < 0 THEN 'closed' WHEN value - 20 < 24 THEN 'under a day' WHEN value - 20 < 72 THEN '1-3 days' WHEN value - 20 < 168 THEN '3-7 days' ELSE 'over a week' END AS bucket,
        count(*) AS cnt FROM events WHERE value IS NOT NULL GROUP BY 1""",
    "a29_percentiles": f"""WITH g AS (SELECT event_type AS name, list_sort(list(value)) AS vs FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT name, CAST(len(vs) AS BIGINT) AS n, {", ".join(f"{_rank(p)} AS p{p}" for p in (10, 25, 50, 75, 90))} FROM g""",
    "a30_detection_lag": f"""WITH g AS (SELECT user_id AS name, list_sort(list(value)) AS vs FROM events WHERE value >= 5 GROUP BY 1)
        SELECT name, CAST(len(vs) AS BIGINT) AS n, {_rank(50)} AS p50, {_rank(90)} AS p90 FROM g""",
    "w05_gap_rhythm": """WITH g AS (SELECT user_id, ts, round((epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts)) / 3600, 2) AS gap FROM events),
        k AS (SELECT user_id AS name, gap FROM g WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5),
        l AS (SELECT name, list_sort(list(gap)) AS gaps FROM k GROUP BY 1)
        SELECT name, CAST(len(gaps) AS INTEGER) AS n, gaps[len(gaps) // 2 + 1] AS typical,
               CASE WHEN len(gaps) >= 2 THEN round(greatest(6.0, least(336.0, gaps[len(gaps) // 2 + 1] * 2.5)), 4) END AS allowed FROM l""",
    "w06_zero_streaks": """WITH i AS (SELECT user_id AS name, value < 30 AS empty, sum(CASE WHEN value < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
        r AS (SELECT name, island, count(*) FILTER (WHERE empty) AS run FROM i GROUP BY ALL)
        SELECT name, max(run) AS longest, arg_max(run, island) AS current FROM r GROUP BY 1""",
    "w09_week_over_week": """WITH w AS (SELECT event_type AS name, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS cnt FROM events GROUP BY ALL)
        SELECT name, week, cnt, cnt - lag(cnt) OVER (PARTITION BY name ORDER BY week) AS delta FROM w""",
    "j21_nearest_snapshot": """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS v, user_id AS u, ts AS t FROM events WHERE event_type = 'click')
        SELECT event_id, user_id, ts, (SELECT v FROM c WHERE u = p.user_id AND abs(epoch_us(t) - epoch_us(p.ts)) <= 172800000000 ORDER BY abs(epoch_us(t) - epoch_us(p.ts)), t, v LIMIT 1) AS nearest FROM p""",
}
