"""The purchase ledger: ranking of buyers and winners, coverage, recall and expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..views import LEDGER, WINS, anchored, ledger, total, wins

#: The statuses that count as a purchase.
PURCHASED = ("accepted", "contract_published")


def dated(rows: DataFrame, *columns: str) -> DataFrame:
    """Those columns of rows with `now`, written once: the ledger is a join of several tables, and the plans below read it more than once."""
    return anchored(written(rows.select("awarded_on", *columns), "ledger"), "awarded_on")


def skip_reason(rows: DataFrame) -> DataFrame:
    """rows with `skipped`, the first reason why a purchase can't be ranked, or null; rows carry `now`."""
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*PURCHASED), F.lit(False)), F.concat(F.lit("status:"), F.coalesce("status", F.lit("None"))))
        .when(F.col("amount_uzs").isNull(), "no_amount")
        .when(F.col("buyer_inn").isNull(), "no_inn")
        .when(F.col("awarded_on").isNull() | (F.col("awarded_on") > F.to_date("now")), "future")
    )
    return rows.withColumn("skipped", reason)


def most_common(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): each key's most frequent value; of equals the shorter, then the first by name."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.length(value), F.col(value))
    return n.groupBy(key).agg(F.min_by(value, order).alias(name))


def rank_buyers(rows: DataFrame, top: int | None = 100) -> DataFrame:
    """Buyers by twice the last year's spending plus the year's before; with name, winners and the largest purchase.

    Sums, extremes and counts are aggregated before the shuffle; the name and the winners come from aggregates by
    (buyer, value), so a buyer with a third of all purchases is never one task's list.
    """
    ok = skip_reason(dated(rows, "status", "amount_uzs", "buyer_inn", "buyer_name", "winner", "profile", "subject", "business_id", "feed")).filter("skipped is null").drop("skipped")
    recent = F.col("awarded_on") >= F.date_sub(F.to_date("now"), 365)
    zero = F.lit(0).cast("decimal(20,2)")
    spend = lambda c: F.sum(F.when(c, F.col("amount_uzs")).otherwise(zero))
    base = ok.groupBy("buyer_inn").agg(
        spend(recent).alias("s12"), spend(~recent).alias("s24"), F.count("*").alias("purchases"),
        F.count_if(F.col("profile") == "poly").alias("poly"), F.count_if(F.col("profile") == "merch").alias("merch"),
        F.max_by(F.struct("amount_uzs", "subject"), F.struct("amount_uzs", "business_id")).alias("big"),
        F.array_join(F.sort_array(F.collect_set("feed")), ",").alias("feeds"), F.max("awarded_on").alias("last"),
    )
    by_winner = ok.groupBy("buyer_inn", F.coalesce("winner", F.lit("?")).alias("winner")).agg(F.sum("amount_uzs").alias("s"))
    place = F.row_number().over(Window.partitionBy("buyer_inn").orderBy(F.desc("s"), "winner"))
    winners = by_winner.withColumn("k", place).filter("k <= 3").groupBy("buyer_inn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "winner"))), lambda x: x["winner"]), "|").alias("winners"))
    out = base.join(most_common(ok, "buyer_inn", "buyer_name", "name"), "buyer_inn", "left").join(winners, "buyer_inn")
    out = out.select(
        "buyer_inn", "name", (F.col("s12") * 2 + F.col("s24")).cast("double").alias("score"), F.col("s12").cast("double").alias("spend12"),
        F.col("s24").cast("double").alias("spend24"), "purchases", "poly", "merch",
        F.round(F.col("big.amount_uzs").cast("double") / (F.col("s12") + F.col("s24")).cast("double"), 4).alias("biggest_share"),
        F.substring("big.subject", 1, 140).alias("biggest_subject"), "winners", "feeds", "last",
    )
    return out.orderBy(F.desc("score"), "buyer_inn").limit(top) if top else out


def skipped_purchases(rows: DataFrame) -> DataFrame:
    """How many purchases the ranking leaves out, by reason."""
    return skip_reason(dated(rows, "status", "amount_uzs", "buyer_inn")).filter("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count("*").alias("cnt"))


def coverage(rows: DataFrame) -> DataFrame:
    """By feed: rows, first day, rows without a number, unlabelled rows."""
    return rows.groupBy("feed").agg(
        F.count("*").alias("total"), F.min("awarded_on").alias("since"),
        F.count_if(F.col("buyer_inn").isNull()).alias("no_inn"), F.count_if(F.col("profile").isNull()).alias("unlabeled"),
    )


def watchlist(decided: DataFrame, top: int = 20) -> DataFrame:
    """Winners by wins, then money: name, sum, and the exact median of the discounts between 0 and 100 percent.

    Discounts are of one decimal, so what a median holds are counts of at most 1,001 values a winner.
    """
    pct = F.round((F.col("start_price") - F.col("won_price")).cast("double") / F.col("start_price").cast("double") * 100, 1)
    ok = (F.col("start_price") > 0) & (F.col("won_price") > 0) & (F.col("won_price") <= F.col("start_price"))
    out = decided.groupBy("winner_inn").agg(
        F.count("*").alias("n"), total("won_price").alias("sum_uzs"), F.round(F.median(F.when(ok, pct)), 1).alias("discount_median"), F.max("winner").alias("name"),
        F.count_if(F.col("feed") == "O").alias("open_feed"),
    )
    return out.orderBy(F.desc("n"), F.desc("sum_uzs"), "winner_inn").limit(top)


def recall(purchases: DataFrame, known: DataFrame) -> DataFrame:
    """Purchases of our profile by feed: how many, and how much money, were among the known ids."""
    hit = known.select(F.col("business_id").alias("k")).distinct()
    ours = purchases.filter("profile <> 'none'").join(hit, F.col("business_id") == F.col("k"), "left")
    seen = F.col("k").isNotNull()
    return ours.groupBy("feed").agg(
        F.count("*").alias("purchases"), F.count_if(seen).alias("known"), total("amount_uzs").alias("money"), total(F.when(seen, F.col("amount_uzs"))).alias("known_money"),
    )


def expected(rows: DataFrame, weeks: int = 6) -> DataFrame:
    """Purchases of the same weeks a year ago, by buyer."""
    old = dated(rows, "buyer_inn", "amount_uzs").filter("buyer_inn is not null and awarded_on >= date_sub(now, 365)").filter(F.col("awarded_on") < F.date_add(F.date_sub("now", 365), 7 * weeks))
    return old.groupBy("buyer_inn").agg(F.count("*").alias("cnt"), total("amount_uzs").alias("total"))


def channel_gaps(rows: DataFrame, top: int = 5) -> DataFrame:
    """By feed: count, sum and the top buyers by sum: of a feed's buyers each task sends on only its own first ones."""
    by = rows.groupBy("feed", "buyer_name").agg(F.count("*").alias("n"), F.sum("amount_uzs").alias("s"))
    place = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("s"), "buyer_name"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("k", "buyer_name"))), lambda x: x["buyer_name"])
    first = by.withColumn("k", place).filter(F.col("k") <= top).groupBy(F.col("feed").alias("f")).agg(F.array_join(names, "|").alias("buyers"))
    sums = by.groupBy("feed").agg(F.sum("n").alias("cnt"), F.sum("s").cast("double").alias("total"))
    return sums.join(first, F.col("feed").eqNullSafe(F.col("f"))).drop("f")


def feed_health(rows: DataFrame, lag: int = 3) -> DataFrame:
    """By feed: the last full week against the mean of the four before, `lag` days late; warn at none or under half."""
    age = F.datediff(F.date_sub("now", lag), "awarded_on")
    now = F.count_if((age >= 0) & (age < 7))
    mean = F.count_if((age >= 7) & (age < 35)) / 4.0
    out = dated(rows, "feed").groupBy("feed").agg(now.alias("week"), mean.alias("usual"))
    return out.withColumn("warn", (F.col("week") == 0) | (F.col("week") < F.col("usual") / 2))


def _l(f, *args, **kw):
    return lambda spark, sf_dir: f(ledger(spark, sf_dir), *args, **kw)



QUERIES = {
    "a15_customer_rank": _l(rank_buyers),
    "a15_skipped_purchases": _l(skipped_purchases),
    "a16_ledger_coverage": _l(coverage),
    "a17_customer_recall": lambda spark, sf_dir: recall(ledger(spark, sf_dir), ledger(spark, sf_dir).filter("amount_uzs > 50000")),
    "a18_competitor_watchlist": lambda spark, sf_dir: watchlist(wins(spark, sf_dir)),
    "a43_channel_gaps": _l(channel_gaps),
    "a46_expected_purchases": _l(expected),
    "a47_feed_health": _l(feed_health),
}

_OK = f"""{LEDGER}, n AS (SELECT max(awarded_on) AS today FROM ledger),
    r AS (SELECT *, CASE WHEN status NOT IN ('accepted', 'contract_published') THEN 'status:' || status WHEN amount_uzs IS NULL THEN 'no_amount'
                         WHEN buyer_inn IS NULL THEN 'no_inn' WHEN awarded_on IS NULL OR awarded_on > today THEN 'future' END AS skipped FROM ledger, n)"""

SQL = {
    "a15_customer_rank": f"""WITH {_OK}, ok AS (SELECT * FROM r WHERE skipped IS NULL),
        b AS (SELECT buyer_inn, sum(CASE WHEN awarded_on >= today - 365 THEN amount_uzs ELSE 0 END) AS s12, sum(CASE WHEN awarded_on < today - 365 THEN amount_uzs ELSE 0 END) AS s24,
                     count(*) AS purchases, count(*) FILTER (WHERE profile = 'poly') AS poly, count(*) FILTER (WHERE profile = 'merch') AS merch,
                     string_agg(DISTINCT feed, ',' ORDER BY feed) AS feeds, max(awarded_on) AS last FROM ok GROUP BY 1),
        g AS (SELECT buyer_inn, amount_uzs, subject FROM ok QUALIFY row_number() OVER (PARTITION BY buyer_inn ORDER BY amount_uzs DESC, business_id DESC) = 1),
        nm AS (SELECT buyer_inn, buyer_name AS name FROM (SELECT buyer_inn, buyer_name, count(*) AS n FROM ok GROUP BY ALL)
               QUALIFY row_number() OVER (PARTITION BY buyer_inn ORDER BY n DESC, length(buyer_name), buyer_name) = 1),
        wi AS (SELECT buyer_inn, string_agg(winner, '|' ORDER BY k) AS winners FROM (
                 SELECT buyer_inn, winner, row_number() OVER (PARTITION BY buyer_inn ORDER BY s DESC, winner) AS k
                 FROM (SELECT buyer_inn, winner, sum(amount_uzs) AS s FROM ok GROUP BY ALL)) WHERE k <= 3 GROUP BY 1)
        SELECT b.buyer_inn, name, CAST(s12 * 2 + s24 AS DOUBLE) AS score, CAST(s12 AS DOUBLE) AS spend12, CAST(s24 AS DOUBLE) AS spend24, purchases, poly, merch,
               round(CAST(g.amount_uzs AS DOUBLE) / CAST(s12 + s24 AS DOUBLE), 4) AS biggest_share, substr(g.subject, 1, 140) AS biggest_subject, winners, feeds, last
        FROM b JOIN g USING (buyer_inn) JOIN nm USING (buyer_inn) JOIN wi USING (buyer_inn) ORDER BY score DESC, buyer_inn LIMIT 100""",
    "a15_skipped_purchases": f"WITH {_OK} SELECT skipped AS reason, count(*) AS cnt FROM r WHERE skipped IS NOT NULL GROUP BY 1",
    "a16_ledger_coverage": f"""WITH {LEDGER} SELECT feed, count(*) AS total, min(awarded_on) AS since, count(*) FILTER (WHERE buyer_inn IS NULL) AS no_inn,
        count(*) FILTER (WHERE profile IS NULL) AS unlabeled FROM ledger GROUP BY 1""",
    "a17_customer_recall": f"""WITH {LEDGER}, k AS (SELECT DISTINCT business_id AS k FROM ledger WHERE amount_uzs > 50000)
        SELECT feed, count(*) AS purchases, count(k) AS known, CAST(sum(amount_uzs) AS DOUBLE) AS money,
        CAST(coalesce(sum(amount_uzs) FILTER (WHERE k IS NOT NULL), 0) AS DOUBLE) AS known_money
        FROM ledger LEFT JOIN k ON k = business_id WHERE profile <> 'none' GROUP BY 1""",
    "a18_competitor_watchlist": f"""WITH {WINS} SELECT winner_inn, count(*) AS n, CAST(sum(won_price) AS DOUBLE) AS sum_uzs,
        round(median(CASE WHEN start_price > 0 AND won_price > 0 AND won_price <= start_price THEN round(CAST(start_price - won_price AS DOUBLE) / CAST(start_price AS DOUBLE) * 100, 1) END), 1) AS discount_median,
        max(winner) AS name, count(*) FILTER (WHERE feed = 'O') AS open_feed FROM wins GROUP BY 1 ORDER BY n DESC, sum_uzs DESC, winner_inn LIMIT 20""",
    "a43_channel_gaps": f"""WITH {LEDGER}, b AS (SELECT feed, buyer_name, count(*) AS n, sum(amount_uzs) AS s FROM ledger GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY s DESC, buyer_name) AS k FROM b)
        SELECT feed, CAST(sum(n) AS BIGINT) AS cnt, CAST(sum(s) AS DOUBLE) AS total, string_agg(buyer_name, '|' ORDER BY k) FILTER (WHERE k <= 5) AS buyers FROM k GROUP BY 1""",
    "a46_expected_purchases": f"""WITH {LEDGER}, n AS (SELECT max(awarded_on) AS today FROM ledger)
        SELECT buyer_inn, count(*) AS cnt, CAST(sum(amount_uzs) AS DOUBLE) AS total FROM ledger, n
        WHERE buyer_inn IS NOT NULL AND awarded_on >= today - 365 AND awarded_on < today - 365 + 42 GROUP BY 1""",
    "a47_feed_health": f"""WITH {LEDGER}, n AS (SELECT max(awarded_on) AS today FROM ledger),
        g AS (SELECT feed, count(*) FILTER (WHERE today - 3 - awarded_on BETWEEN 0 AND 6) AS week, count(*) FILTER (WHERE today - 3 - awarded_on BETWEEN 7 AND 34) / 4.0::DOUBLE AS usual
              FROM ledger, n GROUP BY 1)
        SELECT feed, week, usual, week = 0 OR week < usual / 2 AS warn FROM g""",
}
