"""Rankings and shares over lots and their winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..views import TENDERS, WINS, anchored, tenders, total, wins

UNKNOWN = "Не указан"


def ranked_groups(rows: DataFrame, by: str, amount: str = "price", top: int | None = None) -> DataFrame:
    """Count and sum by a column, unnamed groups together, largest count first (then by name)."""
    name = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit(UNKNOWN))
    out = rows.groupBy(name.alias("name")).agg(F.count("*").alias("cnt"), total(amount).alias("total"))
    return out.orderBy(F.desc("cnt"), "name").limit(top) if top else out


def category_stats(rows: DataFrame) -> DataFrame:
    """Count and sum by each category that a lot has; lots without any are not counted."""
    return ranked_groups(rows.select("price", F.explode("categories").alias("category")), "category")


def average_discount(decided: DataFrame) -> DataFrame:
    """Mean discount in percent over decided lots with a positive start price, and their number."""
    ok = (F.col("start_price") > 0) & F.col("won_price").isNotNull()
    pct = (F.col("start_price") - F.col("won_price")).cast("double") / F.col("start_price").cast("double") * 100
    return decided.agg(F.round(F.avg(F.when(ok, pct)), 4).alias("avg_discount"), F.count_if(ok).alias("cnt"))


def competitor_stats(decided: DataFrame, niche: str) -> DataFrame:
    """By winner: wins, sum, largest, last day, the first five categories by name, and whether any win is of our niche."""
    return decided.groupBy("winner").agg(
        F.count("*").alias("wins"),
        total("won_price").alias("total"),
        F.max("won_price").cast("double").alias("largest"),
        F.to_date(F.max("deal_date")).alias("last_win"),
        F.array_join(F.slice(F.sort_array(F.collect_set(F.substring("category", 1, 50))), 1, 5), "|").alias("categories"),
        F.bool_or(F.col("title").rlike(niche)).alias("niche"),
    )


def organizations_by_sources(rows: DataFrame, least: int = 2) -> DataFrame:
    """Organisations by number of lots, with their sources in order."""
    out = rows.groupBy("organization").agg(F.count("*").alias("cnt"), F.array_join(F.sort_array(F.collect_set("region")), ",").alias("regions"))
    return out.filter(F.col("cnt") >= least)


def seasonality(rows: DataFrame, least: int = 3) -> DataFrame:
    """Organisation and calendar month with at least `least` lots; names under three letters don't count."""
    named = rows.filter(F.length("organization") >= 3)
    return named.groupBy("organization", F.month("collected_at").alias("month")).agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= least)


def predictions(rows: DataFrame, least: int = 3) -> DataFrame:
    """Lots expected in the two months after the newest lot, with a confidence by how often that month recurred."""
    now = rows.agg(F.max("collected_at").alias("now"))
    season = seasonality(rows, least).crossJoin(F.broadcast(now))
    months = season.withColumn("next", F.trunc(F.add_months("now", 1), "month")).withColumn("after", F.trunc(F.add_months("now", 2), "month"))
    sure = F.greatest(F.least(F.bround(F.col("cnt") / 10.0, 2), F.lit(1.0)), F.lit(0.3))
    is_next = F.col("month") == F.month("next")
    when = F.when(is_next, F.col("next")).otherwise(F.col("after"))
    return months.filter(is_next | (F.col("month") == F.month("after"))).select(
        "organization",
        F.month(when).alias("predicted_month"),
        F.year(when).alias("predicted_year"),
        F.round(F.when(is_next, sure).otherwise(F.greatest(sure - 0.1, F.lit(0.2))), 4).alias("confidence"),
    )


def shares(rows: DataFrame, by: str, heavy: float = 5.0) -> DataFrame:
    """Each group's share of all rows in percent, and whether it is heavy."""
    out = rows.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("cnt"))
    share = F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy(F.lit(1)))  # over groups, not rows
    return out.select("name", "cnt", F.round(share, 4).alias("share"), (share >= heavy).alias("heavy"))


def filtered_lots(rows: DataFrame, status: str, categories: list[str], low: float, high: float, without: list[str], n: int) -> DataFrame:
    """The facet query: status, any of the categories, a price range, no excluded word in the name; newest first."""
    out = rows.filter((F.col("status") == status) & F.arrays_overlap("categories", F.array(*map(F.lit, categories))) & F.col("price").between(low, high))
    for word in without:
        escaped = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        out = out.filter(~F.col("organization").ilike(f"%{escaped}%"))
    return out.orderBy(F.desc("collected_at"), "id").limit(n).select("id", "organization", "price", "collected_at")


def contract_concentration(rows: DataFrame, top: int = 5) -> DataFrame:
    """Share of the `top` organisations in all money."""
    by = rows.groupBy("organization").agg(F.sum(F.col("price").cast("decimal(20,2)")).alias("s"))
    rank = by.orderBy(F.desc("s"), "organization").limit(top).agg(F.sum("s").alias("top_sum"))
    return by.agg(F.sum("s").alias("all_sum"), F.count("*").alias("organizations")).crossJoin(rank).select(
        "organizations", F.round(F.col("top_sum").cast("double") / F.col("all_sum").cast("double") * 100, 4).alias("top_share")
    )


def metrics_snapshot(rows: DataFrame) -> DataFrame:
    """Totals of a table in one pass: all, last day, last week, organisations, regions, priced, mean and largest price."""
    back = lambda d: F.count_if(F.col("collected_at") > F.col("now") - F.expr(f"INTERVAL {d} DAYS"))
    return anchored(rows, "collected_at").agg(
        F.count("*").alias("total"), back(1).alias("last_day"), back(7).alias("last_week"),
        F.count_distinct("organization").alias("organizations"), F.count_distinct("region").alias("regions"),
        F.count_if(F.col("price") > 0).alias("priced"), F.round(F.avg("price"), 2).alias("mean_price"), F.max("price").alias("largest"),
    )


def digest_rank(rows: DataFrame, score: str, top: int = 10) -> DataFrame:
    """What a digest shows first: log10(price + 10) * (0.4 + score / 100), 60 for an unknown score."""
    weight = F.log10(F.coalesce(F.col("price"), F.lit(0.0)) + 10) * (0.4 + F.coalesce(F.col(score), F.lit(60)) / 100.0)
    return rows.withColumn("rank_weight", F.round(weight, 6)).orderBy(F.desc("rank_weight"), "id").limit(top).select("id", "price", "rank_weight")


def _t(f, *args, **kw):
    return lambda spark, sf_dir: f(tenders(spark, sf_dir), *args, **kw)


def _w(f, *args, **kw):
    return lambda spark, sf_dir: f(wins(spark, sf_dir), *args, **kw)


def _scored(rows):
    return rows.withColumn("score", F.when(F.col("id") % 3 != 0, (F.col("id") % 101).cast("int")))


QUERIES = {
    "a02_top_buyers": _t(ranked_groups, "organization", top=10),
    "a03_region_stats": _t(ranked_groups, "region"),
    "a04_category_stats": _t(category_stats),
    "a05_average_discount": _w(average_discount),
    "a06_competitor_stats": _w(competitor_stats, "ring|widget"),
    "a08_organizations_by_sources": _t(organizations_by_sources, 5),
    "a12_seasonality": _t(seasonality),
    "a12_predictions": _t(predictions),
    "a24_source_weights": _t(shares, "source"),
    "a37_metrics_snapshot": _t(metrics_snapshot),
    "a38_concentration": _t(contract_concentration),
    "f04_facet_query": _t(filtered_lots, "O", ["1-URGENT", "BUILDING"], 50_000.0, 300_000.0, ["0001", "_x%"], 100),
    "t03_digest_rank": lambda spark, sf_dir: digest_rank(_scored(tenders(spark, sf_dir)), "score"),
}

SQL = {
    "a02_top_buyers": f"""WITH {TENDERS} SELECT coalesce(nullif(organization, ''), '{UNKNOWN}') AS name, count(*) AS cnt,
        CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total FROM tenders GROUP BY 1 ORDER BY cnt DESC, name LIMIT 10""",
    "a03_region_stats": f"""WITH {TENDERS} SELECT coalesce(nullif(region, ''), '{UNKNOWN}') AS name, count(*) AS cnt,
        CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total FROM tenders GROUP BY 1""",
    "a04_category_stats": f"""WITH {TENDERS} SELECT name, count(*) AS cnt, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total
        FROM (SELECT unnest(categories) AS name, price FROM tenders) GROUP BY 1""",
    "a05_average_discount": f"""WITH {WINS} SELECT round(avg(CAST(start_price - won_price AS DOUBLE) / CAST(start_price AS DOUBLE) * 100), 4) AS avg_discount, count(*) AS cnt
        FROM wins WHERE start_price > 0 AND won_price IS NOT NULL""",
    "a06_competitor_stats": f"""WITH {WINS} SELECT winner, count(*) AS wins, CAST(sum(won_price) AS DOUBLE) AS total, CAST(max(won_price) AS DOUBLE) AS largest,
        CAST(max(deal_date) AS DATE) AS last_win, array_to_string(list_sort(list_distinct(list(category)))[1:5], '|') AS categories,
        bool_or(regexp_matches(title, 'ring|widget')) AS niche FROM wins GROUP BY winner""",
    "a08_organizations_by_sources": f"""WITH {TENDERS} SELECT organization, count(*) AS cnt, string_agg(DISTINCT region, ',' ORDER BY region) AS regions
        FROM tenders GROUP BY 1 HAVING count(*) >= 5""",
    "a12_seasonality": f"""WITH {TENDERS} SELECT organization, CAST(month(collected_at) AS INTEGER) AS month, count(*) AS cnt FROM tenders
        WHERE length(organization) >= 3 GROUP BY 1, 2 HAVING count(*) >= 3""",
    "a12_predictions": f"""WITH {TENDERS}, n AS (SELECT max(collected_at) AS t FROM tenders),
        s AS (SELECT organization, month(collected_at) AS m, count(*) AS cnt FROM tenders GROUP BY 1, 2 HAVING count(*) >= 3),
        w AS (SELECT organization, m, cnt, date_trunc('month', t + INTERVAL 1 MONTH) AS a, date_trunc('month', t + INTERVAL 2 MONTH) AS b,
                     greatest(least(round_even(cnt / 10.0, 2), 1.0), 0.3) AS sure FROM s, n)
        SELECT organization, CAST(m AS INTEGER) AS predicted_month, CAST(CASE WHEN m = month(a) THEN year(a) ELSE year(b) END AS INTEGER) AS predicted_year,
               round(CAST(CASE WHEN m = month(a) THEN sure ELSE greatest(sure - 0.1, 0.2) END AS DOUBLE), 4) AS confidence
        FROM w WHERE m IN (month(a), month(b))""",
    "a24_source_weights": f"""WITH {TENDERS}, g AS (SELECT source AS name, count(*) AS cnt FROM tenders GROUP BY 1)
        SELECT name, cnt, round(cnt * 100.0::DOUBLE / sum(cnt) OVER (), 4) AS share, cnt * 100.0::DOUBLE / sum(cnt) OVER () >= 5 AS heavy FROM g""",
    "a37_metrics_snapshot": f"""WITH {TENDERS}, n AS (SELECT max(collected_at) AS t FROM tenders)
        SELECT count(*) AS total, count(*) FILTER (WHERE collected_at > t - INTERVAL 1 DAY) AS last_day, count(*) FILTER (WHERE collected_at > t - INTERVAL 7 DAY) AS last_week,
               count(DISTINCT organization) AS organizations, count(DISTINCT region) AS regions, count(*) FILTER (WHERE price > 0) AS priced,
               round(avg(price), 2) AS mean_price, max(price) AS largest FROM tenders, n""",
    "a38_concentration": f"""WITH {TENDERS}, b AS (SELECT organization, sum(CAST(price AS DECIMAL(20,2))) AS s FROM tenders GROUP BY 1),
        r AS (SELECT sum(s) AS s FROM (SELECT s FROM b ORDER BY s DESC, organization LIMIT 5))
        SELECT count(*) AS organizations, round(CAST(any_value(r.s) AS DOUBLE) / CAST(sum(b.s) AS DOUBLE) * 100, 4) AS top_share FROM b, r""",
    "f04_facet_query": f"""WITH {TENDERS} SELECT id, organization, price, collected_at FROM tenders
        WHERE status = 'O' AND list_has_any(categories, ['1-URGENT', 'BUILDING']) AND price BETWEEN 50000 AND 300000
          AND organization NOT ILIKE '%0001%' AND organization NOT ILIKE '%\\_x\\%%' ESCAPE '\\'
        ORDER BY collected_at DESC, id LIMIT 100""",
    "t03_digest_rank": f"""WITH {TENDERS} SELECT id, price, round(log10(coalesce(price, 0) + 10) * (0.4 + coalesce(CASE WHEN id % 3 <> 0 THEN id % 101 END, 60) / 100.0), 6) AS rank_weight
        FROM tenders ORDER BY rank_weight DESC, id LIMIT 10""",
}
