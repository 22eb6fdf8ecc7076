"""Reports over lots, purchases and crawls: sums, tallies, streaks, orders and differences of sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..views import LEDGER, TENDERS, WINS, anchored, ledger, tenders, total, wins


def summed(rows: DataFrame, by: list[str], amount: str, top: int | None = None) -> DataFrame:
    """Count and money by some columns; with `top`, the largest sums (then by name)."""
    out = rows.groupBy(*by).agg(F.count("*").alias("cnt"), total(amount).alias("total"))
    return out.orderBy(F.desc("total"), *by).limit(top) if top else out


def with_grand_total(rows: DataFrame, by: str) -> DataFrame:
    """Counts by a column and, as `all`, of all rows, in one pass."""
    out = rows.rollup(by).agg(F.count("*").alias("cnt"), F.grouping(by).alias("level"))
    return out.select(F.when(F.col("level") == 1, "all").otherwise(F.col(by)).alias("name"), "cnt")


def daily_share(rows: DataFrame, ts: str, condition: Column) -> DataFrame:
    """By day: rows, and the percentage that meets the condition."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("cnt"), F.round(F.count_if(condition) * 100.0 / F.count("*"), 4).alias("share"))


def value_at_share(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value at index floor(n * share) of each group's sorted values, from counts of distinct values."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return placed.filter(F.col("upto") > F.floor(F.col("n") * F.lit(share))).groupBy(by).agg(F.min(value).alias("at_share"))


def log_window(log: DataFrame, by: str, ts: str, days: int, failed: Column, share: float) -> DataFrame:
    """Calls of the last days by a column: number, percentage that failed, and the value at `share` of the sorted values."""
    recent = anchored(log, ts).filter(F.col(ts) > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    rates = recent.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.count_if(failed) * 100.0 / F.count("*"), 4).alias("failed"))
    return rates.join(value_at_share(recent, by, "value", share), by)


def snapshots(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, day, cnt): how many rows there were by the end of each day that has any."""
    daily = rows.groupBy(by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return daily.select(by, "day", F.sum("n").over(Window.partitionBy(by).orderBy("day")).alias("cnt"))


def against_older(shots: DataFrame, by: str, days: int) -> DataFrame:
    """Each snapshot with the latest one that is at least `days` older, and the difference; without one, nulls."""
    at = F.datediff("day", F.lit("1970-01-01"))
    before = F.last("cnt").over(Window.partitionBy(by).orderBy(at).rangeBetween(Window.unboundedPreceding, -days))
    return shots.withColumn("before", before).withColumn("delta", F.col("cnt") - F.col("before"))


def duplicate_groups(rows: DataFrame, by: str, title: str, org: str) -> DataFrame:
    """By source: groups of lots alike in the first 80 characters of the title and 50 of the buyer, and their lots."""
    groups = rows.groupBy(by, F.substring(title, 1, 80).alias("t"), F.substring(org, 1, 50).alias("o")).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.groupBy(by).agg(F.count("*").alias("groups"), F.sum("n").alias("lots"))


def weekly_estimate(rows: DataFrame, by: str, ts: str, passed: Column, judged: Column, accepted: Column) -> DataFrame:
    """Alerts to expect in a week: passed / days * 7, times the accepted share of the judged; null where none was judged."""
    days = F.datediff(F.to_date(F.max(ts)), F.to_date(F.min(ts))) + 1
    g = rows.groupBy(by).agg(F.count_if(passed).alias("passed"), F.count_if(judged).alias("judged"), F.count_if(accepted).alias("accepted"), days.alias("days"))
    per_week = F.col("passed") * 7.0 / F.col("days") * F.col("accepted") / F.nullif(F.col("judged"), F.lit(0))
    return g.select(by, "passed", F.round(per_week, 4).alias("per_week"))


def below_half_median(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Each source's rows on the newest day against half the median of its earlier days; sources missing that day have 0."""
    daily = anchored(rows, ts).groupBy(by, F.to_date(ts).alias("day"), F.to_date("now").alias("today")).agg(F.count("*").alias("n"))
    g = daily.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("day") == F.col("today"), F.col("n"))), F.lit(0)).alias("current"), F.median(F.when(F.col("day") < F.col("today"), F.col("n"))).alias("median"))
    return g.select(by, "current", "median", (F.col("current") < F.col("median") / 2).alias("alarm"))


def names_of(rows: DataFrame, key: str, name: str) -> DataFrame:
    """By tax number: the distinct names in order, and how many rows."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), "|").alias("names"), F.count("*").alias("hits"))


def deadline_tally(rows: DataFrame, by: str, deadline: str) -> DataFrame:
    """By source and day: how many open lots (deadline not before `now`) end then."""
    return rows.filter(F.col(deadline) >= F.to_date("now")).groupBy(by, F.to_date(deadline).alias("day")).agg(F.count("*").alias("cnt"))


def _age(now: str, then: str) -> Column:
    return (F.unix_timestamp(F.col(now).cast("timestamp")) - F.unix_timestamp(F.col(then).cast("timestamp"))) / 3600.0


def lane_freshness(lanes: DataFrame, rows: DataFrame, by: str, ts: str) -> DataFrame:
    """lanes (name, hours): never, late or ok by the age of a lane's newest row against the table's newest."""
    last = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(F.max(ts).alias("last"), F.max("now").alias("now"))
    state = F.when(F.col("last").isNull(), "never").when(_age("now", "last") > F.col("hours"), "late").otherwise("ok")
    return lanes.join(last, "name", "left").select("name", "last", state.alias("state"))


def prefix_freshness(rows: DataFrame, by: str, ts: str, prefixes: list[str], hours: float) -> DataFrame:
    """For each prefix: newest row of the sources that begin with it, and whether that is within `hours`."""
    named = anchored(rows, ts).groupBy(F.col(by).alias("name")).agg(F.max(ts).alias("last"), F.max("now").alias("now"))
    hit = F.explode(F.array_compact(F.array(*[F.when(F.startswith("name", F.lit(p)), F.lit(p)) for p in prefixes])))
    g = named.select(hit.alias("prefix"), "last", "now").groupBy("prefix").agg(F.max("last").alias("last"), F.max("now").alias("now"))
    wanted = rows.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return wanted.join(g, "prefix", "left").select("prefix", "last", F.coalesce(_age("now", "last") <= hours, F.lit(False)).alias("fresh"))


def digest(rows: DataFrame, by: str, ts: str, deadline: str, days: int) -> DataFrame:
    """By source: fresh lots (open, or published in the last days), archived ones, and whether the source is silent."""
    fresh = (F.col(deadline) >= F.to_date("now")) | (F.col(ts) > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    g = anchored(rows, ts).groupBy(by).agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("archived"))
    return g.withColumn("silent", F.col("fresh") == 0)


def applied_or_waiting(approved: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Approved proposals, each with whether it is applied already."""
    return approved.join(applied, key, "left_semi").withColumn("state", F.lit("applied")).unionByName(approved.join(applied, key, "left_anti").withColumn("state", F.lit("waiting")))


def decline(buckets: DataFrame, by: str, at: str, value: str, last: int) -> DataFrame:
    """(by, streak, monotone): how many buckets in a row up to the newest fell, and whether each of the last `last` did."""
    w = Window.partitionBy(by)
    fell = F.coalesce(F.col(value) < F.lag(value).over(w.orderBy(at)), F.lit(False))
    placed = buckets.withColumn("fell", fell).withColumn("back", F.row_number().over(w.orderBy(F.desc(at))))
    firm = F.min(F.when(~F.col("fell"), F.col("back")))  # the newest bucket that did not fall; the oldest never falls
    return placed.groupBy(by).agg((firm - 1).alias("streak"), F.coalesce(F.bool_and(F.when(F.col("back") < last, F.col("fell"))), F.lit(False)).alias("monotone"))


def commonest(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The most frequent name of each group; of equally frequent ones the first by name."""
    counts = rows.groupBy(by, name).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max("n").alias("n"), F.min_by(name, F.struct(-F.col("n"), name)).alias(name))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by some columns that order it fully."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def most_incomplete(rows: DataFrame, key: str, fields: list[str], top: int) -> DataFrame:
    """The rows to enrich first: most empty fields, then by key."""
    missing = reduce(Column.__add__, [(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").cast("int") for c in fields])
    return rows.select(key, missing.alias("missing")).filter("missing > 0").orderBy(F.desc("missing"), key).limit(top)


def dead_and_revived(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What is gone since `before`, and what has come."""
    return before.select(key).subtract(after.select(key)).withColumn("change", F.lit("dead")).union(after.select(key).subtract(before.select(key)).withColumn("change", F.lit("revived")))


def first_source(rows: DataFrame, key: list[str], source: str, order: list[str]) -> DataFrame:
    """Of rows that sources share, the one of the source that stands first in `order` (then by name)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(order) + 1)
    return rows.groupBy(*key).agg(F.min_by(source, F.struct(rank, source)).alias(source), F.count_distinct(source).alias("sources"))


def by_entity(rows: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Money and number of rows by entity; numbers without an entity stand for themselves as `other`."""
    return summed(rows.join(entities, key, "left").withColumn("entity", F.coalesce("entity", F.lit("other"))), ["entity"], "amount_uzs")


def id_variants(ids: Column) -> Column:
    """The forms under which a number may have been stored: as it is, with leading #, and padded to eight digits."""
    plain = ids.cast("string")
    return F.array(plain, F.concat(F.lit("#"), plain), F.lpad(plain, 8, "0"))


def unseen(rows: DataFrame, key: str, stored: DataFrame, stored_key: str) -> DataFrame:
    """rows none of whose id variants is stored."""
    known = rows.select(key, F.explode(id_variants(F.col(key))).alias(stored_key)).join(stored, stored_key, "left_semi").select(key).distinct()
    return rows.join(known, key, "left_anti")


def alerted_index(rows: DataFrame, key: list[str], ts: str, days: int) -> DataFrame:
    """key -> latest deadline of the alerts of the last days."""
    recent = anchored(rows, ts).filter(F.col(ts) > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(*key).agg(F.max("deadline").alias("deadline"), F.count("*").alias("cnt"))


def represented(rows: DataFrame, group: str, key: str, source: str) -> DataFrame:
    """One row for each group: its first lot, all sources in order, and the number of lots."""
    return rows.groupBy(group).agg(F.min(key).alias(key), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("lots"))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with a deadline of ten days and more after they were collected."""
    return tenders(spark, sf_dir).withColumn("deadline", F.expr("date_add(to_date(collected_at), cast(10 + id % 40 as int))"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def _lanes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", 1.0), ("view", 0.05), ("fax", 4.0)], "name string, hours double")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("buyer_inn"), F.col("c_mktsegment").alias("entity"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("k")), o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct()


QUERIES = {
    "a09_value_by_organization": lambda spark, sf_dir: summed(tenders(spark, sf_dir), ["organization"], "price"),
    "a10_buyers_by_source": lambda spark, sf_dir: summed(tenders(spark, sf_dir), ["organization", "source"], "price"),
    "a11_counts_by_source": lambda spark, sf_dir: with_grand_total(tenders(spark, sf_dir), "source"),
    "a14_top_winners": lambda spark, sf_dir: summed(wins(spark, sf_dir), ["winner"], "won_price", top=10),
    "a22_title_length": lambda spark, sf_dir: wins(spark, sf_dir).groupBy("feed").agg(F.round(F.avg(F.length("title")), 4).alias("mean_length")),
    "a23_daily_failures": lambda spark, sf_dir: daily_share(_events(spark, sf_dir), "ts", F.col("event_type") == "error"),
    "a34_log_window": lambda spark, sf_dir: log_window(_events(spark, sf_dir), "event_type", "ts", 7, F.col("value") > 50, 0.95),
    "a35_weekly_delta": lambda spark, sf_dir: against_older(snapshots(_events(spark, sf_dir), "event_type", "ts"), "event_type", 7),
    "j22_snapshot_six_days": lambda spark, sf_dir: against_older(snapshots(tenders(spark, sf_dir), "source", "collected_at"), "source", 6),
    "a42_duplicate_groups": lambda spark, sf_dir: duplicate_groups(ledger(spark, sf_dir), "feed", "subject", "buyer_name"),
    "a45_weekly_estimate": lambda spark, sf_dir: weekly_estimate(tenders(spark, sf_dir), "source", "collected_at", F.col("price") > 100000, F.col("status") != "P", F.col("status") == "F"),
    "a49_below_half_median": lambda spark, sf_dir: below_half_median(_events(spark, sf_dir), "event_type", "ts"),
    "a50_names_of_numbers": lambda spark, sf_dir: names_of(ledger(spark, sf_dir), "winner_inn", "subject"),
    "a54_source_stats": lambda spark, sf_dir: tenders(spark, sf_dir).groupBy("source").agg(F.count("*").alias("cnt"), F.max("collected_at").alias("last")),
    "a58_deadline_tally": lambda spark, sf_dir: deadline_tally(anchored(_lots(spark, sf_dir), "collected_at"), "source", "deadline"),
    "a62_lane_freshness": lambda spark, sf_dir: lane_freshness(_lanes(spark), _events(spark, sf_dir), "event_type", "ts"),
    "a64_prefix_freshness": lambda spark, sf_dir: prefix_freshness(_events(spark, sf_dir), "event_type", "ts", ["c", "sign", "fax"], 12),
    "a67_scripted_stale": lambda spark, sf_dir: lane_freshness(_lanes(spark), _events(spark, sf_dir), "event_type", "ts").filter("state <> 'ok'").select("name", "state"),
    "a70_digest": lambda spark, sf_dir: digest(_lots(spark, sf_dir), "source", "collected_at", "deadline", 30),
    "a71_source_settings": lambda spark, sf_dir: tenders(spark, sf_dir).groupBy("region").agg(F.count("*").alias("cnt"), F.max("collected_at").alias("last")).orderBy(F.desc("cnt"), "region"),
    "a73_applied_or_waiting": lambda spark, sf_dir: applied_or_waiting(*_split(spark, sf_dir), "k"),
    "w07_decline": lambda spark, sf_dir: decline(_weekly(spark, sf_dir), "event_type", "day", "n", 4),
    "w13_commonest_name": lambda spark, sf_dir: commonest(ledger(spark, sf_dir), "winner_inn", "subject"),
    "w03_last_wins": lambda spark, sf_dir: last_wins(_events(spark, sf_dir).select("user_id", "event_type", "value", "ts", "event_id"), "user_id", ["ts", "event_id"]),
    "w04_latest_label": lambda spark, sf_dir: last_wins(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("chars")), "conv_id", ["turn"]),
    "t01_newest_first": lambda spark, sf_dir: tenders(spark, sf_dir).select("id", "collected_at").orderBy(F.desc("collected_at"), "id").limit(50),
    "t02_price_then_deadline": lambda spark, sf_dir: _lots(spark, sf_dir).select("id", F.when(F.col("status") != "P", F.col("price")).alias("price"), "deadline").orderBy(F.coalesce("price", F.lit(0.0)), F.asc_nulls_last("deadline"), "id"),
    "t04_leads_first": lambda spark, sf_dir: tenders(spark, sf_dir).select("id", (F.col("status") == "P").alias("is_lead")).orderBy(F.desc("is_lead"), "id"),
    "t05_most_incomplete": lambda spark, sf_dir: most_incomplete(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("n_chars")), "doc_id", ["text", "lang", "source", "n_chars"], 200),
    "t07_rank_by_three": lambda spark, sf_dir: summed(ledger(spark, sf_dir).filter("buyer_inn is not null"), ["buyer_inn"], "amount_uzs").orderBy(F.desc("cnt"), F.desc("total"), "buyer_inn").limit(100),
    "t11_failed_last": lambda spark, sf_dir: _events(spark, sf_dir).select("event_id", (F.col("event_type") == "error").alias("failed")).orderBy("failed", "event_id").limit(60),
    "u01_adapters": lambda spark, sf_dir: reduce(DataFrame.unionByName, [_events(spark, sf_dir).select(F.lit("events").alias("adapter"), F.col("event_id").alias("id")), tenders(spark, sf_dir).select(F.lit("lots").alias("adapter"), "id"), table(spark, sf_dir, "pages").select(F.lit("pages").alias("adapter"), F.col("page_id").alias("id"))]),
    "u04_dead_and_revived": lambda spark, sf_dir: dead_and_revived(*_split(spark, sf_dir), "k"),
    "u06_missing_unexcused": lambda spark, sf_dir: reduce(lambda a, b: a.join(b, "k", "left_anti"), [table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))]),
    "u07_first_source": lambda spark, sf_dir: first_source(ledger(spark, sf_dir), ["subject", "buyer_name"], "buyer_type", ["MACHINERY", "BUILDING"]),
    "j14_by_entity": lambda spark, sf_dir: by_entity(ledger(spark, sf_dir), _entities(spark, sf_dir), "buyer_inn"),
    "j09_exact_number": lambda spark, sf_dir: summed(ledger(spark, sf_dir).join(_entities(spark, sf_dir), "buyer_inn"), ["entity"], "amount_uzs"),
    "j20_enabled_missing": lambda spark, sf_dir: _lanes(spark).select("name").join(_events(spark, sf_dir).select(F.col("event_type").alias("name")), "name", "left_anti"),
    "j24_new_misses": lambda spark, sf_dir: ledger(spark, sf_dir).filter("profile <> 'none'").select("business_id", "buyer_inn").join(ledger(spark, sf_dir).filter("status = 'accepted'").select("business_id"), "business_id", "left_anti"),
    "j27_favourites": lambda spark, sf_dir: tenders(spark, sf_dir).select("id", "organization").join(last_wins(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")), "id", ["line", "quantity"]), "id"),
    "j07_unseen": lambda spark, sf_dir: unseen(tenders(spark, sf_dir).select("id"), "id", _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("#"), F.col("event_id").cast("string"))).otherwise(F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("stored")).filter("stored not like '%7'"), "stored"),
    "j08_id_variants": lambda spark, sf_dir: tenders(spark, sf_dir).select("id", F.explode(id_variants(F.col("id"))).alias("variant")),
    "e08_alerted_index": lambda spark, sf_dir: alerted_index(_lots(spark, sf_dir), ["organization", "category"], "collected_at", 14),
    "e10_represented": lambda spark, sf_dir: represented(tenders(spark, sf_dir).withColumn("family", F.concat_ws("|", "organization", F.year("collected_at"))), "family", "id", "category"),
}

_LOTS = f"{TENDERS}, lots AS (SELECT *, CAST(collected_at AS DATE) + CAST(10 + id % 40 AS INTEGER) AS deadline FROM tenders), n AS (SELECT max(collected_at) AS now FROM tenders)"
_FRESH = """WITH l(name, hours) AS (VALUES ('click', 1.0), ('view', 0.05), ('fax', 4.0)), s AS (SELECT event_type AS name, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events),
        f AS (SELECT l.name, last, CASE WHEN last IS NULL THEN 'never' WHEN (epoch(date_trunc('second', now)) - epoch(date_trunc('second', last))) / 3600.0 > hours THEN 'late' ELSE 'ok' END AS state FROM l LEFT JOIN s ON s.name = l.name CROSS JOIN n)"""
_ENTITIES = "en AS (SELECT c_custkey AS buyer_inn, c_mktsegment AS entity FROM customer WHERE c_acctbal > 0)"
_SPLIT = "a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 3000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)"
_OLDER = """shots AS (SELECT {by}, day, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY day) AS BIGINT) AS cnt FROM (SELECT {by}, CAST({ts} AS DATE) AS day, count(*) AS n FROM {rows} GROUP BY ALL)),
        o AS (SELECT *, last_value(cnt) OVER (PARTITION BY {by} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {days} DAYS PRECEDING) AS before FROM shots) SELECT *, cnt - before AS delta FROM o"""
_SUM = "CAST(sum(CAST({} AS DECIMAL(20,2))) AS DOUBLE)"

SQL = {
    "a09_value_by_organization": f"WITH {TENDERS} SELECT organization, count(*) AS cnt, {_SUM.format('price')} AS total FROM tenders GROUP BY 1",
    "a10_buyers_by_source": f"WITH {TENDERS} SELECT organization, source, count(*) AS cnt, {_SUM.format('price')} AS total FROM tenders GROUP BY ALL",
    "a11_counts_by_source": f"WITH {TENDERS} SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS name, count(*) AS cnt FROM tenders GROUP BY ROLLUP (source)",
    "a14_top_winners": f"WITH {WINS} SELECT winner, count(*) AS cnt, CAST(sum(won_price) AS DOUBLE) AS total FROM wins GROUP BY 1 ORDER BY sum(won_price) DESC, winner LIMIT 10",
    "a22_title_length": f"WITH {WINS} SELECT feed, round(avg(length(title)), 4) AS mean_length FROM wins GROUP BY 1",
    "a23_daily_failures": "SELECT CAST(ts AS DATE) AS day, count(*) AS cnt, round(count(*) FILTER (WHERE event_type = 'error') * CAST(100 AS DOUBLE) / count(*), 4) AS share FROM events GROUP BY 1",
    "a34_log_window": """WITH r AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS)
        SELECT event_type, count(*) AS calls, round(count(*) FILTER (WHERE value > 50) * CAST(100 AS DOUBLE) / count(*), 4) AS failed,
               list_sort(list(value))[CAST(floor(count(*) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1] AS at_share FROM r GROUP BY 1""",
    "a35_weekly_delta": "WITH " + _OLDER.format(by="event_type", ts="ts", rows="events", days=7),
    "j22_snapshot_six_days": f"WITH {TENDERS}, " + _OLDER.format(by="source", ts="collected_at", rows="tenders", days=6),
    "a42_duplicate_groups": f"""WITH {LEDGER}, g AS (SELECT feed, count(*) AS n FROM ledger GROUP BY feed, subject[:80], buyer_name[:50] HAVING count(*) > 1)
        SELECT feed, count(*) AS groups, CAST(sum(n) AS BIGINT) AS lots FROM g GROUP BY 1""",
    "a45_weekly_estimate": f"""WITH {TENDERS}, g AS (SELECT source, count(*) FILTER (WHERE price > 100000) AS passed, count(*) FILTER (WHERE status <> 'P') AS judged, count(*) FILTER (WHERE status = 'F') AS accepted,
        date_diff('day', min(CAST(collected_at AS DATE)), max(CAST(collected_at AS DATE))) + 1 AS days FROM tenders GROUP BY 1)
        SELECT source, passed, round(passed * CAST(7 AS DOUBLE) / days * accepted / nullif(judged, 0), 4) AS per_week FROM g""",
    "a49_below_half_median": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT CAST(max(ts) AS DATE) AS today FROM events),
        g AS (SELECT event_type, CAST(coalesce(sum(n) FILTER (WHERE day = today), 0) AS BIGINT) AS current, median(n) FILTER (WHERE day < today) AS median FROM d CROSS JOIN t GROUP BY 1) SELECT *, current < median / 2 AS alarm FROM g""",
    "a50_names_of_numbers": f"WITH {LEDGER} SELECT winner_inn, array_to_string(list_sort(list(DISTINCT subject)), '|') AS names, count(*) AS hits FROM ledger GROUP BY 1",
    "a54_source_stats": f"WITH {TENDERS} SELECT source, count(*) AS cnt, max(collected_at) AS last FROM tenders GROUP BY 1",
    "a58_deadline_tally": f"WITH {_LOTS} SELECT source, deadline AS day, count(*) AS cnt FROM lots CROSS JOIN n WHERE deadline >= CAST(now AS DATE) GROUP BY ALL",
    "a62_lane_freshness": f"{_FRESH} SELECT * FROM f",
    "a64_prefix_freshness": """WITH p(prefix) AS (VALUES ('c'), ('sign'), ('fax')), n AS (SELECT max(ts) AS now FROM events), g AS (SELECT prefix, max(ts) AS last FROM p LEFT JOIN events ON starts_with(event_type, prefix) GROUP BY 1)
        SELECT prefix, last, coalesce((epoch(date_trunc('second', now)) - epoch(date_trunc('second', last))) / 3600.0 <= 12, false) AS fresh FROM g CROSS JOIN n""",
    "a67_scripted_stale": f"{_FRESH} SELECT name, state FROM f WHERE state <> 'ok'",
    "a70_digest": f"""WITH {_LOTS}, f AS (SELECT source, deadline >= CAST(now AS DATE) OR collected_at > now - INTERVAL 30 DAYS AS fresh FROM lots CROSS JOIN n)
        SELECT source, count(*) FILTER (WHERE fresh) AS fresh, count(*) FILTER (WHERE NOT fresh) AS archived, count(*) FILTER (WHERE fresh) = 0 AS silent FROM f GROUP BY 1""",
    "a71_source_settings": f"WITH {TENDERS} SELECT region, count(*) AS cnt, max(collected_at) AS last FROM tenders GROUP BY 1",
    "a73_applied_or_waiting": f"WITH {_SPLIT} SELECT k, CASE WHEN k IN (SELECT k FROM b) THEN 'applied' ELSE 'waiting' END AS state FROM a",
    "w07_decline": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
        p AS (SELECT event_type, coalesce(n < lag(n) OVER (PARTITION BY event_type ORDER BY day), false) AS fell, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS back FROM d)
        SELECT event_type, CAST(min(back) FILTER (WHERE NOT fell) - 1 AS INTEGER) AS streak, coalesce(bool_and(fell) FILTER (WHERE back < 4), false) AS monotone FROM p GROUP BY 1""",
    "w13_commonest_name": f"""WITH {LEDGER}, c AS (SELECT winner_inn, subject, count(*) AS n FROM ledger GROUP BY ALL)
        SELECT winner_inn, n, subject FROM c QUALIFY row_number() OVER (PARTITION BY winner_inn ORDER BY n DESC, subject) = 1""",
    "w03_last_wins": "SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "w04_latest_label": "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "t01_newest_first": f"WITH {TENDERS} SELECT id, collected_at FROM tenders ORDER BY collected_at DESC, id LIMIT 50",
    "t02_price_then_deadline": f"WITH {_LOTS} SELECT id, CASE WHEN status <> 'P' THEN price END AS price, deadline FROM lots ORDER BY coalesce(CASE WHEN status <> 'P' THEN price END, 0), deadline NULLS LAST, id",
    "t04_leads_first": f"WITH {TENDERS} SELECT id, status = 'P' AS is_lead FROM tenders ORDER BY is_lead DESC, id",
    "t05_most_incomplete": """WITH m AS (SELECT doc_id, CAST(coalesce(text, '') = '' AS INTEGER) + CAST(coalesce(lang, '') = '' AS INTEGER) + CAST(coalesce(source, '') = '' AS INTEGER) + CAST(coalesce(n_chars <= 1000, true) AS INTEGER) AS missing FROM documents)
        SELECT * FROM m WHERE missing > 0 ORDER BY missing DESC, doc_id LIMIT 200""",
    "t07_rank_by_three": f"WITH {LEDGER} SELECT buyer_inn, count(*) AS cnt, CAST(sum(amount_uzs) AS DOUBLE) AS total FROM ledger WHERE buyer_inn IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, sum(amount_uzs) DESC, buyer_inn LIMIT 100",
    "t11_failed_last": "SELECT event_id, event_type = 'error' AS failed FROM events ORDER BY failed, event_id LIMIT 60",
    "u01_adapters": "SELECT 'events' AS adapter, event_id AS id FROM events UNION ALL SELECT 'lots', o_orderkey FROM orders UNION ALL SELECT 'pages', page_id FROM pages",
    "u04_dead_and_revived": f"WITH {_SPLIT} (SELECT k, 'dead' AS change FROM a WHERE k NOT IN (SELECT k FROM b)) UNION ALL (SELECT k, 'revived' FROM b WHERE k NOT IN (SELECT k FROM a))",
    "u06_missing_unexcused": "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "u07_first_source": f"""WITH {LEDGER}, g AS (SELECT DISTINCT subject, buyer_name, buyer_type, CASE buyer_type WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS r FROM ledger)
        SELECT subject, buyer_name, arg_min(buyer_type, row(r, buyer_type)) AS buyer_type, count(*) AS sources FROM g GROUP BY ALL""",
    "j14_by_entity": f"WITH {LEDGER}, {_ENTITIES} SELECT coalesce(entity, 'other') AS entity, count(*) AS cnt, CAST(sum(amount_uzs) AS DOUBLE) AS total FROM ledger LEFT JOIN en ON en.buyer_inn = ledger.buyer_inn GROUP BY 1",
    "j09_exact_number": f"WITH {LEDGER}, {_ENTITIES} SELECT entity, count(*) AS cnt, CAST(sum(amount_uzs) AS DOUBLE) AS total FROM ledger JOIN en ON en.buyer_inn = ledger.buyer_inn GROUP BY 1",
    "j20_enabled_missing": "SELECT name FROM (VALUES ('click'), ('view'), ('fax')) v(name) WHERE name NOT IN (SELECT event_type FROM events)",
    "j24_new_misses": f"WITH {LEDGER} SELECT business_id, buyer_inn FROM ledger WHERE profile <> 'none' AND business_id NOT IN (SELECT business_id FROM ledger WHERE status = 'accepted')",
    "j27_favourites": f"""WITH {TENDERS}, f AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS quantity FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) = 1)
        SELECT t.id, organization, line, quantity FROM tenders t JOIN f ON f.id = t.id""",
    "j07_unseen": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id % 10 <> 7)",
    "j08_id_variants": "SELECT o_orderkey AS id, unnest([CAST(o_orderkey AS VARCHAR), '#' || o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0')]) AS variant FROM orders",
    "e08_alerted_index": f"WITH {_LOTS} SELECT organization, category, max(deadline) AS deadline, count(*) AS cnt FROM lots CROSS JOIN n WHERE collected_at > now - INTERVAL 14 DAYS GROUP BY ALL",
    "e10_represented": f"WITH {TENDERS} SELECT organization || '|' || year(collected_at) AS family, min(id) AS id, array_to_string(list_sort(list(DISTINCT category)), ',') AS sources, count(*) AS lots FROM tenders GROUP BY 1",
}
