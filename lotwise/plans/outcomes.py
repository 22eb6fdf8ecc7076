"""What became of alerts: feedback, funnels, verdicts, the merge of results, and what was missed and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..views import TENDERS, tenders, total
from .identity import first_of

#: The results that count as known.
RESULTS = ("won_by_us", "won_by_other", "no_deal")
#: Feeds whose purchases are never announced, and feeds that are crawled.
UNANNOUNCED, CRAWLED = ("direct", "ebirja_shop"), ("deals", "civil", "ebirja_auction", "ebirja_tender", "ebirja_selection")


def system_verdict(category: Column, score: Column) -> Column:
    """A stored relevance decision as one token; everything shown was at least alerted."""
    c = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(c.isin("client", "ad", "irrelevant"), c).when(score >= 70, "client").when(score.isNotNull(), "weak").otherwise("alerted")


def feedback_stats(rows: DataFrame) -> DataFrame:
    """rows (original, corrected): shown but bad, good but underrated, and the share of neither; 0 without any row."""
    bad = F.col("corrected").isin("ad", "irrelevant")
    under = (F.col("corrected") == "client") & F.col("original").isin("ad", "irrelevant", "weak")
    n = rows.agg(F.count("*").alias("total"), F.count_if(bad).alias("false_positives"), F.count_if(under).alias("false_negatives"))
    right = F.col("total") - F.col("false_positives") - F.col("false_negatives")
    return n.withColumn("accuracy", F.when(F.col("total") > 0, F.round(right / F.col("total") * 100, 1)).otherwise(0.0))


def funnel(rows: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Actions and results of alerts, the unknown ones among them as counts of their own."""
    act, res = F.col("our_action"), F.col("lot_result")
    is_bid = F.coalesce(act == "bid", F.lit(False))
    known = F.coalesce(res.isin(*RESULTS), F.lit(False))
    one = lambda c, v: F.count_if(c == v).alias(v)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), one(act, "bid"), one(act, "passed"), F.count_if(~F.coalesce(act.isin("bid", "passed"), F.lit(False))).alias("action_unknown"),
        *[one(res, r) for r in RESULTS], F.count_if(~known).alias("result_unknown"), F.count_if(is_bid & F.coalesce(res == "won_by_us", F.lit(False))).alias("bid_and_won"), F.count_if(is_bid & res.isNull()).alias("bid_result_unknown"),
    )


def merge_results(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What to write over existing: nothing over a manual result, nothing that is the same, the rest as it came."""
    old = existing.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("lot_result", "result_source", "winner")])
    joined = incoming.filter(F.col("lot_result").isNotNull()).join(old, F.col(key) == F.col("_key"), "left")
    manual = F.coalesce(F.col("_result_source").startswith("button"), F.lit(False))
    same = F.col("_key").isNotNull() & F.col("_lot_result").eqNullSafe(F.col("lot_result")) & F.col("_result_source").eqNullSafe(F.col("result_source")) & F.col("_winner").eqNullSafe(F.col("winner"))
    return joined.filter(~manual & ~same).select(*incoming.columns)


def latest_labels(labels: DataFrame, key: str, order: str) -> DataFrame:
    """The last label of each alert."""
    return labels.groupBy(key).agg(F.max_by("label", F.struct(order, "label")).alias("label"))


def source_scorecard(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """By source: alerts, marks, hits and misses, and whether the source is to be demoted, is productive, or unrated."""
    a = alerts.groupBy("source").agg(F.count("*").alias("alerts"))
    m = labels.groupBy("source").agg(F.count("*").alias("fb"), F.count_if(F.col("good") == 1).alias("hit"), F.count_if(F.col("good") == 0).alias("miss"))
    n = a.join(m, "source", "full_outer").fillna(0, ["alerts", "fb", "hit", "miss"])
    rate = F.col("miss") / F.col("fb")
    verdict = F.when((F.col("fb") >= 5) & (rate >= 0.8) & (F.col("hit") == 0), "demote").when(F.col("hit") >= 3, "productive").when((F.col("alerts") >= 10) & (F.col("fb") == 0), "unrated").otherwise("ok")
    return n.withColumn("verdict", verdict)


def miss_type(feed: Column, won: Column, found: Column, covered: Column, rejected: Column, alerted: Column, late: Column) -> Column:
    """Why a purchase of our profile was not ours, the first reason that holds."""
    return (
        F.when(won, "WON")
        .when(feed.isin(*UNANNOUNCED), "B_no_announcement")
        .when(~F.coalesce(feed.isin(*CRAWLED), F.lit(False)), "C_uncrawled_platform")
        .when(~found & ~covered, "PRE_COVERAGE")
        .when(~found, "A_not_collected")
        .when(rejected, "KNOWN_REJECTED")
        .when(alerted & late, "A_late")
        .when(alerted, "KNOWN_LOST")
        .otherwise("A_filter")
    )


def evidence(awards: DataFrame, rows: DataFrame) -> DataFrame:
    """awards (procedure_id), rows (source_url, deadline, sent_at, message_id): what the rows prove about each award's alert."""
    r = rows.select(F.regexp_extract("source_url", r"/lot/([0-9]+)$", 1).alias("procedure_id"), "deadline", "sent_at", "message_id")
    n = r.groupBy("procedure_id").agg(F.count("*").alias("n"), F.count("deadline").alias("active"), F.count_if(F.col("deadline").isNotNull() & F.col("sent_at").isNotNull()).alias("sent"), F.count_if(F.col("deadline").isNotNull() & F.col("message_id").isNotNull()).alias("messages"))
    outcome = F.when(F.col("n").isNull(), "no_snapshot_match").when(F.col("active") == 0, "only_result_rows").when(F.col("sent") > 0, "active_row_with_sent_timestamp").when(F.col("messages") > 0, "message_time_missing").otherwise("active_row_without_alert_evidence")
    return awards.join(n, "procedure_id", "left").select(*awards.columns, outcome.alias("reason"))


def weekly_estimate(passed: Column, days: Column, accepted: Column, judged: Column) -> Column:
    return F.when((days > 0) & (judged > 0), F.round(passed / days * 7 * accepted / judged, 2))


def dictionary_coverage(rows: DataFrame, pattern: str) -> DataFrame:
    """Share of lots, and of money, whose category a dictionary knows."""
    hit = F.col("category").rlike(pattern)
    n = rows.agg(F.count("*").alias("lots"), F.count_if(hit).alias("hits"), total("price").alias("money"), total(F.when(hit, F.col("price"))).alias("hit_money"))
    return n.select("lots", "hits", F.round(F.col("hits") / F.col("lots"), 4).alias("share"), F.round(F.col("hit_money") / F.col("money"), 4).alias("money_share"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts with an action and a result."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(k % 4 == 0, "bid").when(k % 4 == 1, "passed")
    result = F.when(k % 5 == 0, "won_by_us").when(k % 5 == 1, "won_by_other").when(k % 5 == 2, "no_deal")
    return e.select(k.alias("alert_seq"), "ts", F.col("event_type").alias("source"), action.alias("our_action"), result.alias("lot_result"), F.concat(F.lit("w"), k % 9).alias("winner"), F.when(k % 6 == 0, "button:me").otherwise("auto").alias("result_source"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _alerts(spark, sf_dir).select("alert_seq", "lot_result", "result_source", "winner")
    incoming = rows.withColumn("winner", F.when(F.col("alert_seq") % 7 == 0, "other").otherwise(F.col("winner"))).withColumn("result_source", F.lit("auto"))
    return merge_results(rows.filter("winner < 'w6'"), incoming, "alert_seq")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        system_verdict(F.when(k % 5 == 0, "Client").when(k % 5 == 1, "ad"), F.when(k % 5 < 4, (k % 100).cast("int"))).alias("original"), F.when(k % 3 == 0, "client").when(k % 3 == 1, "irrelevant").otherwise("ad").alias("corrected")
    )
    return feedback_stats(rows)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("alert_seq"), "ts", F.col("event_type").alias("label"))
    return latest_labels(rows, "alert_seq", "ts")


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("source", F.concat_ws("/", "event_type", F.col("user_id") % 50))
    return source_scorecard(e.filter("event_type <> 'view'"), e.filter("(value > 60 or value < 3) and event_type <> 'click'").select("source", (F.col("value") > 30).cast("int").alias("good")))


def _misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    feeds = F.element_at(F.array(*map(F.lit, ("deals", "direct", "civil", "ebirja_shop", "other", "ebirja_auction"))), (k % 6 + 1).cast("int"))
    rows = tenders(spark, sf_dir).select(miss_type(feeds, k % 41 == 0, k % 3 > 0, k % 4 > 0, k % 11 == 0, k % 2 == 0, k % 10 == 0).alias("miss_type"))
    return rows.groupBy("miss_type").agg(F.count("*").alias("cnt"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.concat(F.lit("https://x/lot/"), k % 4000).alias("source_url"), F.when(k % 3 > 0, F.col("ts")).alias("deadline"), F.when(k % 7 == 0, F.col("ts")).alias("sent_at"), F.when(k % 5 == 0, k).alias("message_id"))
    return evidence(spark.range(0, 4500).select(F.col("id").cast("string").alias("procedure_id")), rows)


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements of one procedure under two spellings of its number: the first stays."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("result-2612"), F.when(F.col("o_orderkey") % 2 == 0, "00").otherwise("05"), F.lpad((F.floor(F.col("o_orderkey") / 3)).cast("string"), 8, "0")).alias("external_id"))
    bare = F.regexp_replace("external_id", "^result-", "")
    key = F.when(bare.rlike("^[0-9]{14}$"), F.concat(F.substring(bare, 1, 4), F.substring(bare, 7, 8))).otherwise(bare)
    return first_of(o.withColumn("key", key), ["key"], ["o_orderkey"]).select("key", "o_orderkey")


QUERIES = {
    "a13_monthly_funnel": lambda spark, sf_dir: funnel(_alerts(spark, sf_dir), [F.date_format("ts", "yyyy-MM").alias("month")]),
    "a31_feedback_stats": _feedback,
    "a25_source_scorecard": _scorecard,
    "a17_miss_types": _misses,
    "a44_dictionary_coverage": lambda spark, sf_dir: dictionary_coverage(tenders(spark, sf_dir), "^[12]-"),
    "j04_merge_results": _merge,
    "j06_latest_labels": _labels,
    "j11_alert_evidence": _evidence,
    "e11_settlement_key": _first,
}

_A = """a AS (SELECT event_id AS alert_seq, ts, event_type AS source, CASE event_id % 4 WHEN 0 THEN 'bid' WHEN 1 THEN 'passed' END AS our_action, CASE event_id % 5 WHEN 0 THEN 'won_by_us' WHEN 1 THEN 'won_by_other' WHEN 2 THEN 'no_deal' END AS lot_result,
    'w' || event_id % 9 AS winner, CASE WHEN event_id % 6 = 0 THEN 'button:me' ELSE 'auto' END AS result_source FROM events)"""

SQL = {
    "a13_monthly_funnel": f"""WITH {_A} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, count(*) FILTER (WHERE our_action = 'bid') AS bid, count(*) FILTER (WHERE our_action = 'passed') AS passed, count(*) FILTER (WHERE our_action IS NULL) AS action_unknown,
        count(*) FILTER (WHERE lot_result = 'won_by_us') AS won_by_us, count(*) FILTER (WHERE lot_result = 'won_by_other') AS won_by_other, count(*) FILTER (WHERE lot_result = 'no_deal') AS no_deal, count(*) FILTER (WHERE lot_result IS NULL) AS result_unknown,
        count(*) FILTER (WHERE our_action = 'bid' AND lot_result = 'won_by_us') AS bid_and_won, count(*) FILTER (WHERE our_action = 'bid' AND lot_result IS NULL) AS bid_result_unknown FROM a GROUP BY 1""",
    "a31_feedback_stats": """WITH r AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'client' WHEN event_id % 5 = 1 THEN 'ad' WHEN event_id % 5 = 4 THEN 'alerted' WHEN event_id % 100 >= 70 THEN 'client' ELSE 'weak' END AS original,
            CASE event_id % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'irrelevant' ELSE 'ad' END AS corrected FROM events),
        n AS (SELECT count(*) AS total, count(*) FILTER (WHERE corrected IN ('ad', 'irrelevant')) AS false_positives, count(*) FILTER (WHERE corrected = 'client' AND original IN ('ad', 'irrelevant', 'weak')) AS false_negatives FROM r)
        SELECT *, round((total - false_positives - false_negatives) / total::DOUBLE * 100, 1) AS accuracy FROM n""",
    "a25_source_scorecard": """WITH e AS (SELECT *, event_type || '/' || user_id % 50 AS source FROM events), a AS (SELECT source, count(*) AS alerts FROM e WHERE event_type <> 'view' GROUP BY 1),
        m AS (SELECT source, count(*) AS fb, count(*) FILTER (WHERE value > 30) AS hit, count(*) FILTER (WHERE value <= 30) AS miss FROM e WHERE (value > 60 OR value < 3) AND event_type <> 'click' GROUP BY 1),
        n AS (SELECT coalesce(a.source, m.source) AS source, coalesce(alerts, 0) AS alerts, coalesce(fb, 0) AS fb, coalesce(hit, 0) AS hit, coalesce(miss, 0) AS miss FROM a FULL JOIN m ON a.source = m.source)
        SELECT *, CASE WHEN fb >= 5 AND miss >= 0.8 * fb AND hit = 0 THEN 'demote' WHEN hit >= 3 THEN 'productive' WHEN alerts >= 10 AND fb = 0 THEN 'unrated' ELSE 'ok' END AS verdict FROM n""",
    "a17_miss_types": """WITH t AS (SELECT o_orderkey AS id, ['deals', 'direct', 'civil', 'ebirja_shop', 'other', 'ebirja_auction'][o_orderkey % 6 + 1] AS feed FROM orders)
        SELECT CASE WHEN id % 41 = 0 THEN 'WON' WHEN feed IN ('direct', 'ebirja_shop') THEN 'B_no_announcement' WHEN feed = 'other' THEN 'C_uncrawled_platform' WHEN id % 3 = 0 AND id % 4 = 0 THEN 'PRE_COVERAGE' WHEN id % 3 = 0 THEN 'A_not_collected'
            WHEN id % 11 = 0 THEN 'KNOWN_REJECTED' WHEN id % 10 = 0 THEN 'A_late' WHEN id % 2 = 0 THEN 'KNOWN_LOST' ELSE 'A_filter' END AS miss_type, count(*) AS cnt FROM t GROUP BY 1""",
    "a44_dictionary_coverage": f"""WITH {TENDERS} SELECT count(*) AS lots, count(*) FILTER (WHERE regexp_matches(category, '^[12]-')) AS hits, round(count(*) FILTER (WHERE regexp_matches(category, '^[12]-')) / count(*)::DOUBLE, 4) AS share,
        round(CAST(sum(CAST(price AS DECIMAL(20,2))) FILTER (WHERE regexp_matches(category, '^[12]-')) AS DOUBLE) / CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE), 4) AS money_share FROM tenders""",
    "j04_merge_results": f"""WITH {_A}, i AS (SELECT alert_seq, lot_result, 'auto' AS result_source, CASE WHEN alert_seq % 7 = 0 THEN 'other' ELSE winner END AS winner FROM a WHERE lot_result IS NOT NULL)
        SELECT i.* FROM i LEFT JOIN (SELECT * FROM a WHERE winner < 'w6') o ON o.alert_seq = i.alert_seq
        WHERE NOT coalesce(starts_with(o.result_source, 'button'), false) AND NOT (o.alert_seq IS NOT NULL AND o.lot_result IS NOT DISTINCT FROM i.lot_result AND o.result_source IS NOT DISTINCT FROM i.result_source AND o.winner IS NOT DISTINCT FROM i.winner)""",
    "j06_latest_labels": "SELECT event_id % 3000 AS alert_seq, arg_max(event_type, ts) AS label FROM events GROUP BY 1",
    "j11_alert_evidence": """WITH r AS (SELECT CAST(event_id % 4000 AS VARCHAR) AS p, event_id % 3 > 0 AS active, event_id % 7 = 0 AS sent, event_id % 5 = 0 AS message FROM events),
        n AS (SELECT p, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE active AND sent) AS sent, count(*) FILTER (WHERE active AND message) AS messages FROM r GROUP BY 1)
        SELECT CAST(range AS VARCHAR) AS procedure_id, CASE WHEN p IS NULL THEN 'no_snapshot_match' WHEN active = 0 THEN 'only_result_rows' WHEN sent > 0 THEN 'active_row_with_sent_timestamp' WHEN messages > 0 THEN 'message_time_missing' ELSE 'active_row_without_alert_evidence' END AS reason
        FROM range(0, 4500) LEFT JOIN n ON p = CAST(range AS VARCHAR)""",
    "e11_settlement_key": "SELECT '2612' || lpad(CAST(o_orderkey // 3 AS VARCHAR), 8, '0') AS key, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
}
