"""The register of customers through rebuilds, firms that are watched, and the converters of single sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import numbered, table
from ..views import WINS, wins
from .conversion import MOST_TEXT

#: Columns of an entity that people keep by hand.
MANUAL = ("pinned", "note")


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def rebuilt(ranked: DataFrame, previous: DataFrame, top: int) -> DataFrame:
    """The register (inn, name, rank, score, pinned, note) of a ranking (inn, name, rank, score), after the previous one.

    The first `top` are in it and all that are pinned, wherever they stand; pinned ones that the ranking lacks stay without a
    rank and with score 0. What people keep by hand comes from the previous register.
    """
    old = previous.select(F.col("inn").alias("_inn"), F.col("name").alias("_name"), *MANUAL)
    both = ranked.join(old, ranked["inn"] == old["_inn"], "full")
    pinned = F.coalesce("pinned", F.lit(False))
    return both.filter((F.col("rank") <= top) | pinned).select(
        F.coalesce("inn", "_inn").alias("inn"), F.coalesce("name", "_name").alias("name"), "rank", F.coalesce("score", F.lit(0)).alias("score"), pinned.alias("pinned"), "note"
    )


def watched_wins(decided: DataFrame, watch: DataFrame) -> DataFrame:
    """Of each watched firm (inn, name): wins, their sum and median discount in percent, customers, and how many wins the gate hid.

    Sums and discounts take wins in UZS alone; a discount needs both prices, and the won one not above the start. The median is
    that of counted distinct discounts, so no firm's wins are gathered in a list. Firms without wins are left out.
    """
    w = watch.select(F.col("inn").alias("_inn"), "name")
    uzs = (F.col("currency") == "UZS") & (F.col("won_price") > 0)
    off = F.when(uzs & (F.col("start_price") > 0) & (F.col("won_price") <= F.col("start_price")), F.round((1 - F.col("won_price").cast("double") / F.col("start_price").cast("double")) * 100, 1))
    joined = decided.join(w, decided["winner_inn"] == w["_inn"]).withColumn("off", off)
    sums = joined.groupBy("winner_inn", "name").agg(
        F.count("*").alias("wins"), F.coalesce(F.sum(F.when(uzs, F.col("won_price"))).cast("double"), F.lit(0.0)).alias("sum_uzs"),
        F.count_distinct("category").alias("customers"), F.count_if("hidden").alias("hidden"),
    )
    return sums.join(median_of(joined.filter("off is not null"), "winner_inn", "off", "discount"), "winner_inn", "left")


def median_of(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """(by, name): the median of a column, the mean of the two middle values if there are two."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    upto, all_ = F.sum("_n").over(Window.partitionBy(by).orderBy(value)), F.sum("_n").over(Window.partitionBy(by))
    placed = counts.select(by, value, upto.alias("_upto"), (upto - F.col("_n")).alias("_from"), all_.alias("_all"))
    middle = lambda k: F.min(F.when((F.col("_from") <= k) & (k < F.col("_upto")), F.col(value)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return placed.groupBy(by).agg(((middle(low) + middle(high)) / 2).alias(name))


def new_names(decided: DataFrame, watch: DataFrame) -> DataFrame:
    """All winners with a number that aren't watched, with their wins: candidates for the list."""
    others = decided.filter("winner_inn is not null and not hidden").join(watch.select(F.col("inn").alias("winner_inn")), "winner_inn", "left_anti")
    return others.groupBy("winner_inn").agg(F.max("winner").alias("winner"), F.count("*").alias("wins"))


def competition_rows(items: DataFrame) -> DataFrame:
    """Competitions (id, category_name, cost, currency_name, region, district, ends) as rows; without a category the title is the number."""
    category = _filled("category_name")
    return items.select(
        F.concat(F.lit("competition-"), "id").alias("id"), F.coalesce(category, F.concat(F.lit("Конкурс #"), "id")).alias("title"), F.nullif(F.col("cost"), F.lit(0.0)).alias("price"),
        F.coalesce(_filled("currency_name"), F.lit("UZS")).alias("currency"), F.concat_ws(", ", _filled("region"), _filled("district")).alias("region"),
        F.array_join(F.array_compact(F.array(category)), "|").alias("categories"), "ends",
    )


def notice_rows(notices: DataFrame, now: Column) -> DataFrame:
    """Notices as rows: the title is the first of project, description and number; they close with their deadline or without one."""
    title = F.coalesce(_filled("project"), F.substring(_filled("description"), 1, 200), F.concat(F.lit("WB Notice #"), "id"))
    return notices.select(
        F.concat(F.lit("wb-"), "id").alias("id"), F.coalesce(_filled("reference"), F.col("id").cast("string")).alias("external_id"), title.alias("title"),
        F.array_join(F.array_compact(F.array(_filled("kind"), _filled("method"))), "|").alias("categories"),
        F.when(F.col("deadline") > now, "active").otherwise("closed").alias("status"),
        F.substring(F.concat_ws(" ", _filled("project"), _filled("description"), _filled("kind")), 1, MOST_TEXT).alias("search_text"),
    )


def probe_rows(lots: DataFrame) -> DataFrame:
    """Lots (id, category, names, customer) as rows: the title is the category and the first three distinct positions; all are searched."""
    names = F.array_distinct(F.filter(F.transform("names", lambda x: F.trim(x)), lambda x: x != ""))
    title = F.concat(F.col("category"), F.when(F.size(names) > 0, F.concat(F.lit(": "), F.array_join(F.slice(names, 1, 3), "; "))).otherwise(""))
    return lots.select("id", F.substring(title, 1, 300).alias("title"), F.size("names").alias("positions"), F.substring(F.concat_ws(" ", "category", F.array_join(names, " "), "customer"), 1, MOST_TEXT).alias("search_text"))


def time_ago(seconds: Column) -> Column:
    """How long ago, in the largest whole unit of minutes, hours and days."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 60, "только что").when(seconds < 3600, F.concat(whole(60), F.lit(" мин назад"))).when(seconds < 86400, F.concat(whole(3600), F.lit("ч назад")))
        .otherwise(F.concat(whole(86400), F.lit("д назад")))
    )


def price_label(price: Column, currency: Column) -> Column:
    """Thousands parted by no-break blanks, a comma before decimals of which there are three at most; a dash for no price."""
    digits = F.translate(F.regexp_replace(F.format_number(price, 3), r"\.?0+$", ""), ",.", " ,")
    return F.when(price.isNull(), "—").otherwise(F.concat(digits, F.lit(" "), currency))


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("score"), F.max("o_orderkey").alias("last"))
    ranked = numbered(spent.withColumnRenamed("o_custkey", "inn"), F.desc("score"), "inn").join(c.select(F.col("c_custkey").alias("inn"), F.col("c_name").alias("name")), "inn")
    previous = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("inn"), F.concat("c_name", F.lit(" old")).alias("name"), (F.col("c_custkey") % 12 == 0).alias("pinned"), F.col("c_mktsegment").alias("note"))
    return rebuilt(ranked, previous, 50)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wins(spark, sf_dir).withColumn("hidden", F.col("feed") == "O").withColumn("currency", F.when(F.col("line") == 5, "USD").otherwise("UZS"))


def _watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("inn"), F.lower("s_name").alias("name"))


def _competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return competition_rows(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("category_name"), F.when(k % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("cost"), F.when(k % 2 == 0, "USD").otherwise("").alias("currency_name"), F.when(k % 7 > 0, "R").alias("region"), F.when(k % 4 > 0, "D").alias("district"), F.to_date("o_orderdate").alias("ends")))


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "Project").otherwise(" ").alias("project"), F.when(k % 2 == 0, F.repeat(F.col("o_orderpriority"), 60)).alias("description"), F.when(k % 5 > 0, F.concat(F.lit("R"), k)).alias("reference"),
        F.col("o_orderpriority").alias("kind"), F.when(k % 4 == 0, "open").alias("method"), F.when(k % 6 > 0, F.to_date("o_orderdate")).alias("deadline"),
    )
    return notice_rows(rows, F.lit("1997-01-01").cast("date"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return probe_rows(p.select(k.alias("id"), F.col("p_type").alias("category"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", F.lit(" "), "p_brand", "p_name", F.lit("third"), F.lit("fourth"))).alias("names"), F.concat(F.lit("c"), k).alias("customer")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.when(k % 9 > 0, k * 1000 + (k % 4) * 0.25)
    return table(spark, sf_dir, "orders").select("o_orderkey", time_ago(k * 37).alias("ago"), price_label(price, F.lit("UZS")).alias("price"))


QUERIES = {
    "e15_rebuilt_register": _register,
    "a19_watched_wins": lambda spark, sf_dir: watched_wins(_decided(spark, sf_dir), _watch(spark, sf_dir)),
    "a19_new_names": lambda spark, sf_dir: new_names(_decided(spark, sf_dir), _watch(spark, sf_dir)),
    "p31_competitions": _competitions,
    "p32_notices": _notices,
    "p34_probe_rows": _probe,
    "p37_labels": _labels,
}

SQL = {
    "e15_rebuilt_register": """WITH s AS (SELECT o_custkey AS inn, count(*) AS score FROM orders GROUP BY 1), r AS (SELECT inn, c_name AS name, score, row_number() OVER (ORDER BY score DESC, inn) AS rank FROM s JOIN customer ON c_custkey = inn),
        p AS (SELECT c_custkey AS inn, c_name || ' old' AS name, c_custkey % 12 = 0 AS pinned, c_mktsegment AS note FROM customer WHERE c_custkey % 4 = 0)
        SELECT coalesce(r.inn, p.inn) AS inn, coalesce(r.name, p.name) AS name, rank, coalesce(score, 0) AS score, coalesce(pinned, false) AS pinned, note FROM r FULL JOIN p ON p.inn = r.inn WHERE rank <= 50 OR pinned""",
    "a19_watched_wins": f"""WITH {WINS} SELECT winner_inn, lower(s_name) AS name, count(*) AS wins, CAST(coalesce(sum(won_price) FILTER (WHERE line <> 5), 0) AS DOUBLE) AS sum_uzs, count(DISTINCT category) AS customers, count(*) FILTER (WHERE feed = 'O') AS hidden,
            median(round((1 - CAST(won_price AS DOUBLE) / CAST(start_price AS DOUBLE)) * 100, 1)) FILTER (WHERE line <> 5 AND start_price > 0 AND won_price <= start_price) AS discount
        FROM wins JOIN supplier ON s_suppkey = winner_inn WHERE winner_inn % 3 = 0 GROUP BY 1, 2""",
    "a19_new_names": f"WITH {WINS} SELECT winner_inn, max(winner) AS winner, count(*) AS wins FROM wins WHERE winner_inn % 3 > 0 AND feed <> 'O' GROUP BY 1",
    "p31_competitions": """SELECT 'competition-' || o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'Конкурс #' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 > 0 THEN nullif(o_totalprice, 0) END AS price,
        CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'UZS' END AS currency, concat_ws(', ', CASE WHEN o_orderkey % 7 > 0 THEN 'R' END, CASE WHEN o_orderkey % 4 > 0 THEN 'D' END) AS region,
        CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS categories, CAST(o_orderdate AS DATE) AS ends FROM orders""",
    "p32_notices": """WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Project' END AS p, CASE WHEN o_orderkey % 2 = 0 THEN repeat(o_orderpriority, 60) END AS d, o_orderpriority AS k, o_orderkey % 6 > 0 AND CAST(o_orderdate AS DATE) > DATE '1997-01-01' AS ahead FROM orders)
        SELECT 'wb-' || id AS id, CASE WHEN id % 5 > 0 THEN 'R' ELSE '' END || id AS external_id, coalesce(p, substr(d, 1, 200), 'WB Notice #' || id) AS title, k || CASE WHEN id % 4 = 0 THEN '|open' ELSE '' END AS categories,
        CASE WHEN ahead THEN 'active' ELSE 'closed' END AS status, substr(concat_ws(' ', p, d, k), 1, 2000) AS search_text FROM n""",
    "p34_probe_rows": """SELECT p_partkey AS id, p_type || CASE WHEN p_partkey % 4 > 0 THEN ': ' || p_name || '; ' || p_brand || '; third' ELSE '' END AS title, CASE WHEN p_partkey % 4 > 0 THEN 6 ELSE 0 END AS positions,
        p_type || ' ' || CASE WHEN p_partkey % 4 > 0 THEN p_name || ' ' || p_brand || ' third fourth' ELSE '' END || ' c' || p_partkey AS search_text FROM part""",
    "p37_labels": """WITH o AS (SELECT o_orderkey, o_orderkey * 37 AS s, o_orderkey * 1000 AS w, ['', ',25', ',5', ',75'][o_orderkey % 4 + 1] AS f FROM orders)
        SELECT o_orderkey, CASE WHEN s < 60 THEN 'только что' WHEN s < 3600 THEN s // 60 || ' мин назад' WHEN s < 86400 THEN s // 3600 || 'ч назад' ELSE s // 86400 || 'д назад' END AS ago,
        CASE WHEN o_orderkey % 9 = 0 THEN '—' ELSE replace(format('{:,}', w), ',', chr(160)) || f || ' UZS' END AS price FROM o""",
}
