"""The entities of procurement analytics over the driver's tables, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def money(c: Column | str) -> Column:
    """Exact money, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,2)")


def total(c: Column | str) -> Column:
    return F.coalesce(F.sum(money(c)), F.lit(0).cast("decimal(20,2)")).cast("double")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots: orders with their customer as the organisation. customer and nation are dimensions that Spark may broadcast."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, nation.n_nationkey == customer.c_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("source"),
        F.col("c_name").alias("organization"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("collected_at"),
        F.col("n_name").alias("region"),
        F.col("o_orderpriority").alias("category"),
        F.array("o_orderpriority", "c_mktsegment").alias("categories"),
    )


TENDERS = """tenders AS (
    SELECT o_orderkey AS id, c_mktsegment AS source, c_name AS organization, o_totalprice AS price, o_orderstatus AS status,
           o_orderdate AS collected_at, n_name AS region, o_orderpriority AS category, [o_orderpriority, c_mktsegment] AS categories
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided lots: lineitem with its supplier as the winner and the discounted price as what was paid."""
    lines, supplier, part = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    joined = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(part, part.p_partkey == lines.l_partkey)
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("s_suppkey").alias("winner_inn"),
        F.col("s_name").alias("winner"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("title"),
        money("l_extendedprice").alias("start_price"),
        (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(20,2)").alias("won_price"),
        F.col("l_shipdate").alias("deal_date"),
        F.col("l_linestatus").alias("feed"),
    )


WINS = """wins AS (
    SELECT l_orderkey AS id, l_linenumber AS line, s_suppkey AS winner_inn, s_name AS winner, p_type AS category, p_name AS title,
           CAST(l_extendedprice AS DECIMAL(20,2)) AS start_price,
           CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(20,2)) AS won_price,
           l_shipdate AS deal_date, l_linestatus AS feed
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases: who bought what of whom. Individuals have no number, as customers of the last nation here."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    w = wins(spark, sf_dir)
    joined = w.join(orders, w.id == orders.o_orderkey).join(customer, customer.c_custkey == orders.o_custkey)
    profile = F.when(F.col("category") == "PROMO", "merch").when(F.col("category").isin("SMALL", "MEDIUM"), "poly").otherwise("none")
    return joined.select(
        F.concat_ws("-", "id", "line").alias("business_id"),
        F.when(F.col("c_nationkey") < 24, F.col("c_custkey")).alias("buyer_inn"),
        F.col("c_name").alias("buyer_name"),
        F.col("c_mktsegment").alias("buyer_type"),
        "winner_inn",
        "winner",
        F.col("won_price").alias("amount_uzs"),
        F.to_date("deal_date").alias("awarded_on"),
        F.col("title").alias("subject"),
        profile.alias("profile"),
        F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "contract_published").otherwise("protocol").alias("status"),
        F.concat(F.lit("feed_"), "feed").alias("feed"),
    )


LEDGER = f"""{WINS}, ledger AS (
    SELECT w.id || '-' || w.line AS business_id, CASE WHEN c_nationkey < 24 THEN c_custkey END AS buyer_inn, c_name AS buyer_name,
           c_mktsegment AS buyer_type, winner_inn, winner, won_price AS amount_uzs, CAST(deal_date AS DATE) AS awarded_on, title AS subject,
           CASE WHEN w.category = 'PROMO' THEN 'merch' WHEN w.category IN ('SMALL', 'MEDIUM') THEN 'poly' ELSE 'none' END AS profile,
           CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'contract_published' ELSE 'protocol' END AS status,
           'feed_' || feed AS feed
    FROM wins w JOIN orders ON o_orderkey = w.id JOIN customer ON c_custkey = o_custkey)"""


def anchored(df: DataFrame, time: str) -> DataFrame:
    """df with `now`, the newest time of the table: one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(time).alias("now"))))
