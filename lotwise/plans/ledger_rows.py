"""Rows of the purchase ledger and of auctions from raw records, rows as the interface reads them, and counts kept between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import table

#: Failed tries after which a detail is given up.
MOST_FAILS = 6
RAW = (
    "deal_id string, id string, civil_contract_id string, display_id string, trade_id string, contract_id string, customer_tin string, customer_name string, "
    "customer_type_name string, provider_tin string, provider_name string, category_name string, deal_cost string, start_cost string, currency string, deal_date string"
)


def _clean(c: str) -> Column:
    return F.nullif(text.collapse(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def _amount(c: str) -> Column:
    """A number as records write it, blanks as thousands marks and a comma as the decimal one; null if it is none."""
    return F.regexp_replace(F.regexp_replace(F.col(c), r"[\s\xa0]", ""), ",", ".").try_cast("decimal(20,2)")


def ledger_rows(records: DataFrame) -> DataFrame:
    """records (feed, raw): JSON of the feeds deals, direct and civil -> one row of the ledger each, without those that have no number of their own.

    A direct purchase lists only the section of the classifier: that is its category, and its subject is left to its details. The
    lot's key is the procedure of a deal and the displayed number of a civil contract. Sums in UZS stand in a column of their own.
    """
    r = records.select("feed", F.from_json("raw", RAW).alias("r"), F.sha2("raw", 256).alias("raw_sha256")).select("feed", "raw_sha256", "r.*")
    number = F.when(F.col("feed") == "deals", _clean("deal_id")).when(F.col("feed") == "direct", _clean("id")).otherwise(F.coalesce(_clean("civil_contract_id"), _clean("display_id")))
    lot = F.when(F.col("feed") == "deals", _clean("trade_id")).when(F.col("feed") == "civil", F.concat(F.lit("result-"), _clean("display_id")))
    direct, title = F.col("feed") == "direct", _clean("category_name")
    currency = F.coalesce(F.upper(_clean("currency")), F.lit("UZS"))
    day = F.to_date(F.substring("deal_date", 1, 10).try_cast("date"))
    return r.select(
        "feed", number.alias("business_id"), _clean("trade_id").alias("procedure_id"), _clean("contract_id").alias("contract_number"),
        text.buyer_inn(F.col("customer_tin"), F.col("customer_name")).alias("buyer_inn"), _clean("customer_name").alias("buyer_name"), _clean("customer_type_name").alias("buyer_type"),
        text.normalize_inn(F.col("provider_tin")).alias("winner_inn"), _clean("provider_name").alias("winner_name"), F.when(direct, title).alias("category"), F.when(~direct, title).alias("subject"),
        F.when(~direct, text.subject_hash(F.col("category_name"))).alias("subject_hash"), _amount("deal_cost").alias("amount"), currency.alias("currency"),
        F.when(currency == "UZS", _amount("deal_cost")).alias("amount_uzs"), _amount("start_cost").alias("start_amount"), day.alias("awarded_on"), lot.alias("lot_key"), "raw_sha256",
    ).filter("business_id is not null")


def auction_rows(items: DataFrame, source: str, prefix: str, link: str) -> DataFrame:
    """items (id, categoryName, customerName, startCost, startDate, endDate, regionName, description, seen) as lots; the last seen of an id counts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = [c for c in items.columns if c not in ("id", "seen")]
    last = items.groupBy("id").agg(F.max_by(F.struct(*values), F.struct("seen", F.to_json(F.struct(*values)))).alias("r")).select("id", "r.*")
    parts = F.filter(F.array("categoryName", "customerName", "regionName", "description"), lambda x: x.isNotNull() & (x != ""))
    return last.select(
        F.concat(F.lit(f"{prefix}-"), F.col("id").cast("string")).alias("external_id"), blank("categoryName").alias("title"), blank("customerName").alias("organization"), F.nullif(F.col("startCost"), F.lit(0.0)).alias("price"),
        F.lit("UZS").alias("currency"), blank("endDate").alias("deadline"), blank("startDate").alias("date_start"), blank("regionName").alias("region"), F.lit(source).alias("source"),
        F.concat(F.lit(link), F.col("id").cast("string")).alias("source_url"), F.array_join(parts, " ").alias("search_text"),
    )


def interface_rows(rows: DataFrame) -> DataFrame:
    """Stored rows (external_id, price_formatted, extra_info JSON, collected_at, created_at ...) under the names that the interface reads."""
    names = {"external_id": "externalId", "price_formatted": "priceFormatted", "date_start": "dateStart", "source_url": "sourceUrl", "matched_keywords": "matchedKeywords"}
    kept = [F.col(c).alias(names.get(c, c)) for c in rows.columns if c not in ("collected_at", "created_at", "extra_info")]
    shot = F.nullif(F.get_json_object("extra_info", "$.screenshot_url"), F.lit(""))
    return rows.select(*kept, F.coalesce("collected_at", "created_at").alias("collectedAt"), shot.alias("previewScreenshotUrl"), F.col("extra_info").alias("extraInfo"))


def price_band(rows: DataFrame, low: float, high: float, since: Column) -> DataFrame:
    """(category, n, alerted, share) of judged rows (price, score, category, alert, at) from low to under high since a day, by category."""
    band = rows.filter((F.col("price") >= low) & (F.col("price") < high) & F.col("score").isNotNull() & (F.col("at") >= since))
    sums = band.groupBy("category").agg(F.count("*").alias("n"), F.count("alert").alias("alerted"))
    total = sums.agg(F.sum("n").alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(total)).select("category", "n", "alerted", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def advanced_fails(fails: DataFrame, tried: DataFrame, live: DataFrame, most: int = MOST_FAILS) -> tuple[DataFrame, DataFrame]:
    """(id, fails) to keep after a run, and (id) of those given up by it; fails (id, fails), tried (id, ok), live (id).

    What failed counts one more, what came through or isn't listed any more is forgotten; with `most` failures an id is given
    up. An id that was tried several times in a run came through if any try did.
    """
    run = tried.groupBy("id").agg(F.max(F.col("ok").cast("int")).alias("ok"))
    both = fails.join(run, "id", "full").join(live.select("id").distinct(), "id", "left_semi")
    now = both.filter("ok is null or ok = 0").select("id", (F.coalesce("fails", F.lit(0)) + F.when(F.col("ok") == 0, 1).otherwise(0)).alias("fails"))
    return now.filter(F.col("fails") < most), now.filter(F.col("fails") >= most).select("id")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer as raw records of three feeds."""
    o, c, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), F.col("o_orderkey")
    s = lambda x: x.cast("string")
    feed = F.when(k % 3 == 0, "deals").when(k % 3 == 1, "direct").otherwise("civil")
    raw = F.struct(
        F.when(k % 5 > 0, s(k)).alias("deal_id"), s(k * 2).alias("id"), F.when(k % 4 > 0, s(k * 3)).alias("civil_contract_id"), F.concat(F.lit(" D "), s(k)).alias("display_id"), F.when(k % 7 > 0, F.concat(F.lit("t"), s(k))).alias("trade_id"),
        F.lit("").alias("contract_id"), F.when(k % 2 == 0, s(200_000_000 + F.col("c_custkey"))).otherwise(s(F.col("c_custkey"))).alias("customer_tin"), F.concat("c_name", F.lit("  x")).alias("customer_name"), F.col("c_mktsegment").alias("customer_type_name"),
        s(300_000_000 + k).alias("provider_tin"), F.lit(None).cast("string").alias("provider_name"), F.col("o_orderpriority").alias("category_name"), F.regexp_replace(F.format_string("%d 000,50", k), "x", "").alias("deal_cost"),
        F.when(k % 6 == 0, "n/a").otherwise(s(k)).alias("start_cost"), F.when(k % 8 == 0, "usd").alias("currency"), F.concat(s(F.to_date("o_orderdate")), F.lit("T10:00")).alias("deal_date"),
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(feed.alias("feed"), F.to_json(raw).alias("raw"))


def _auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(
        F.floor(k / 2).alias("id"), F.col("o_orderpriority").alias("categoryName"), F.when(k % 3 > 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("customerName"), F.when(k % 5 > 0, F.col("o_totalprice")).otherwise(0.0).alias("startCost"),
        F.to_date("o_orderdate").cast("string").alias("startDate"), F.lit(None).cast("string").alias("endDate"), F.when(k % 2 == 0, "R").otherwise("").alias("regionName"), F.lit("d").alias("description"), k.alias("seen"),
    )
    return auction_rows(items, "Auctions", "auc", "https://x/lot/")


def _interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    extra = F.when(k % 3 == 0, F.concat(F.lit('{"screenshot_url": "s'), k, F.lit('.png"}'))).when(k % 3 == 1, "{}")
    return interface_rows(table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("e"), k).alias("external_id"), F.col("o_totalprice").alias("price"), F.lit("f").alias("price_formatted"), F.when(k % 4 > 0, day).alias("collected_at"), F.date_sub(day, 1).alias("created_at"), extra.alias("extra_info")))


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.when(k % 3 > 0, k % 100).alias("score"), F.col("o_orderpriority").alias("category"), F.when(k % 5 == 0, k).alias("alert"), F.to_date("o_orderdate").alias("at"))
    return price_band(rows, 50_000, 200_000, F.lit("1995-01-01").cast("date"))


def _fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    kept, given = advanced_fails(
        o.filter("o_orderkey % 3 = 0").select(k.alias("id"), (k % 6).cast("int").alias("fails")), o.filter("o_orderkey % 2 = 0").select(k.alias("id"), (k % 4 == 0).alias("ok")), o.filter("o_orderkey % 5 > 0").select(k.alias("id"))
    )
    return kept.withColumn("given_up", F.lit(False)).unionByName(given.select("id", F.lit(MOST_FAILS).alias("fails"), F.lit(True).alias("given_up")))


QUERIES = {
    "p17_ledger_rows": lambda spark, sf_dir: ledger_rows(_raw(spark, sf_dir)).drop("raw_sha256", "subject_hash"),
    "p26_auction_rows": _auctions,
    "p29_interface_rows": _interface,
    "a52_price_band": _band,
    "st08_advanced_fails": _fails,
}

SQL = {
    "p17_ledger_rows": """WITH o AS (SELECT o_orderkey AS k, ['deals', 'direct', 'civil'][o_orderkey % 3 + 1] AS feed, * FROM orders JOIN customer ON c_custkey = o_custkey),
        r AS (SELECT *, CASE feed WHEN 'deals' THEN CASE WHEN k % 5 > 0 THEN CAST(k AS VARCHAR) END WHEN 'direct' THEN CAST(k * 2 AS VARCHAR) ELSE CASE WHEN k % 4 > 0 THEN CAST(k * 3 AS VARCHAR) ELSE 'D ' || k END END AS business_id, CASE WHEN k % 7 > 0 THEN 't' || k END AS trade,
            CAST(k * 1000 + 0.5 AS DECIMAL(20,2)) AS amount, CASE WHEN k % 8 = 0 THEN 'USD' ELSE 'UZS' END AS cur FROM o)
        SELECT feed, business_id, trade AS procedure_id, NULL AS contract_number, CASE WHEN k % 2 = 0 THEN CAST(200000000 + c_custkey AS VARCHAR) END AS buyer_inn, c_name || ' x' AS buyer_name, c_mktsegment AS buyer_type, CAST(300000000 + k AS VARCHAR) AS winner_inn, NULL AS winner_name,
            CASE WHEN feed = 'direct' THEN o_orderpriority END AS category, CASE WHEN feed <> 'direct' THEN o_orderpriority END AS subject, amount, cur AS currency, CASE WHEN cur = 'UZS' THEN amount END AS amount_uzs, CASE WHEN k % 6 > 0 THEN CAST(k AS DECIMAL(20,2)) END AS start_amount,
            CAST(o_orderdate AS DATE) AS awarded_on, CASE feed WHEN 'deals' THEN trade WHEN 'civil' THEN 'result-D ' || k END AS lot_key FROM r WHERE business_id IS NOT NULL""",
    "p26_auction_rows": """WITH i AS (SELECT o_orderkey // 2 AS id, arg_max(o_orderkey, o_orderkey) AS k FROM orders GROUP BY 1)
        SELECT 'auc-' || id AS external_id, o_orderpriority AS title, CASE WHEN k % 3 > 0 THEN 'c' || o_custkey ELSE '' END AS organization, CASE WHEN k % 5 > 0 THEN nullif(o_totalprice, 0) END AS price, 'UZS' AS currency, '' AS deadline, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_start,
            CASE WHEN k % 2 = 0 THEN 'R' ELSE '' END AS region, 'Auctions' AS source, 'https://x/lot/' || id AS source_url, concat_ws(' ', o_orderpriority, CASE WHEN k % 3 > 0 THEN 'c' || o_custkey END, CASE WHEN k % 2 = 0 THEN 'R' END, 'd') AS search_text FROM i JOIN orders ON o_orderkey = k""",
    "p29_interface_rows": """SELECT o_orderkey AS id, 'e' || o_orderkey AS externalId, o_totalprice AS price, 'f' AS priceFormatted, CAST(CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) - 1 END AS DATE) AS collectedAt,
        CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey || '.png' END AS previewScreenshotUrl, CASE o_orderkey % 3 WHEN 0 THEN '{"screenshot_url": "s' || o_orderkey || '.png"}' WHEN 1 THEN '{}' END AS extraInfo FROM orders""",
    "a52_price_band": """WITH b AS (SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS alerted FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 200000 AND o_orderkey % 3 > 0 AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01' GROUP BY 1)
        SELECT category, n, alerted, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM b""",
    "st08_advanced_fails": """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 6 ELSE 0 END + CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS fails FROM orders WHERE o_orderkey % 5 > 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 2 = 0) AND o_orderkey % 4 > 0)
        SELECT id, CAST(fails AS INT) AS fails, fails >= 6 AS given_up FROM b""",
}
