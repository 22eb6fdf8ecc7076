"""Records of sources: JSON paths and predicates over events, chat demand over conversations, quality of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..session import table

#: Fields whose presence makes a source's quality, and their weights.
QUALITY = {"organization": 0.30, "price": 0.30, "deadline": 0.20, "region": 0.10, "source_url": 0.10}


def completeness(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Percent of rows of each group with each field, one row a (group, field)."""
    full = [F.round(F.avg((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("int")) * 100, 1).alias(f) for f in fields]
    return rows.groupBy(F.col(by).alias("name")).agg(*full).unpivot("name", fields, "metric", "value")


def quality_score(rows: DataFrame, by: str) -> DataFrame:
    """Weighted completeness by source; sources with many rows weigh no more than others in the mean."""
    share = lambda f: F.avg((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("int"))
    score = sum((share(f) * w for f, w in QUALITY.items()), F.lit(0.0)) * 100
    by_source = rows.groupBy(F.col(by).alias("name")).agg(F.round(score, 1).alias("score"), F.count("*").alias("cnt"))
    return by_source.withColumn("overall", F.round(F.avg("score").over(Window.partitionBy(F.lit(1))), 2))  # over sources


def demand_gate(rows: DataFrame, demand: str, advert: str, least: int = 50) -> DataFrame:
    """rows with the verdict of a chat message: demand is required, an advert or too small a quantity rejects."""
    low = F.lower("text")
    quantity = F.regexp_extract(low, r"([0-9]{1,6}) ?(ta|dona|шт|pcs)", 1).try_cast("int")
    verdict = F.when(~low.rlike(demand), "no_demand").when(low.rlike(advert), "advert").when(F.coalesce(quantity < least, F.lit(False)), "small").otherwise("lead")
    return rows.withColumn("verdict", F.coalesce(verdict, F.lit("no_demand")))


def document_frequency(rows: DataFrame, top: int = 15) -> DataFrame:
    """The words and pairs of neighbours found in most messages, each counted once a message."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-zа-яёäöüßéèàçñóíáú']+"), 0), lambda w: F.length(w) > 2)
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    both = rows.select(words.alias("w")).select(F.explode(F.concat(F.array_distinct("w"), F.array_distinct(pairs))).alias("gram"))
    counted = both.groupBy("gram").agg(F.count("*").alias("cnt")).withColumn("kind", F.when(F.col("gram").contains(" "), "bigram").otherwise("unigram"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cnt"), "gram"))
    return counted.withColumn("k", place).filter(F.col("k") <= top).select("kind", "gram", "cnt")


def latest_by_section(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a nested record: a list of lots beside the props."""
    events = table(spark, sf_dir, "events")
    lot = lambda k: F.struct((F.col("event_id") % 5 + k).cast("double").alias("qty"), F.round(F.col("value"), 0).alias("price"), F.when(F.col("event_id") % 3 == k, "paper").otherwise("ink").alias("name"))
    record = F.to_json(F.struct(F.struct("user_id", "event_type").alias("head"), F.array(lot(0), lot(1)).alias("lots")))
    return events.withColumn("record", record)


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("record")
    return _json(spark, sf_dir).select(
        "event_id", paths.at_path(r, "head.user_id").alias("user"), paths.at_path(r, "lots.1.name").alias("second"), paths.at_path(r, "lots.7.name").alias("missing"),
        F.array_join(paths.values_at(r, "lots[*].name"), "|").alias("names"), paths.template(r, "{head.event_type} / {head.user_id}").alias("label"), paths.sum_over(r, "lots", "qty", "price").alias("total"),
    )


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"head.event_type": {"in": ["click", "view", "error"]}, "head.user_id": {"gt": 20, "lte": 120}, "lots[*].name": "paper", "absent.path": {"ne": "x"}, "lots.0.price": {"gte": 10}}
    return _json(spark, sf_dir).filter(paths.item_filter(F.col("record"), spec)).select("event_id")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    some = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    return events.select(
        F.col("event_type").alias("source"), some(3, F.lit("org")).alias("organization"), some(4, F.col("value")).alias("price"), some(2, F.lit("")).alias("deadline"), some(5, F.lit("region")).alias("region"), F.col("props").alias("source_url")
    )


DEMAND, ADVERT = "nt|que|en ", "the |les "


QUERIES = {
    "p02_json_paths": _paths,
    "f01_item_filter": _filtered,
    "a20_completeness": lambda spark, sf_dir: completeness(_fields(spark, sf_dir), "source", list(QUALITY)),
    "a21_quality_score": lambda spark, sf_dir: quality_score(_fields(spark, sf_dir), "source"),
    "f17_demand_gate": lambda spark, sf_dir: demand_gate(table(spark, sf_dir, "conversations"), DEMAND, ADVERT).select("conv_id", "turn", "verdict"),
    "a41_document_frequency": lambda spark, sf_dir: document_frequency(table(spark, sf_dir, "conversations").filter("role = 'user'")),
    "a65_latest_by_section": lambda spark, sf_dir: latest_by_section(table(spark, sf_dir, "events")),
    "p09_goods_title": lambda spark, sf_dir: table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("x")).select("l_orderkey", text.goods_title(F.col("x.p_name"), 2).alias("title")),
    "p14_html_price": lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", text.html_price(F.when(F.col("o_orderkey") % 3 == 0, F.format_number("o_totalprice", 2)).when(F.col("o_orderkey") % 3 == 1, F.replace(F.format_string("%.2f сум", "o_totalprice"), F.lit("."), F.lit(","))).otherwise(F.format_string("UZS %.0f", "o_totalprice"))).alias("price")),
}

_RECORD = """j AS (SELECT event_id, user_id, event_type, event_id % 5 + 0.0::DOUBLE AS q0, event_id % 5 + 1.0::DOUBLE AS q1, round(value, 0) AS price, CASE WHEN event_id % 3 = 0 THEN 'paper' ELSE 'ink' END AS n0, CASE WHEN event_id % 3 = 1 THEN 'paper' ELSE 'ink' END AS n1 FROM events)"""
_FIELDS = """f AS (SELECT event_type AS name, (event_id % 3 <> 0)::INT AS organization, (event_id % 4 <> 0)::INT AS price, 0 AS deadline, (event_id % 5 <> 0)::INT AS region, (props <> '')::INT AS source_url FROM events)"""

SQL = {
    "p02_json_paths": f"""WITH {_RECORD} SELECT event_id, CAST(user_id AS VARCHAR) AS user, n1 AS second, CAST(NULL AS VARCHAR) AS missing, n0 || '|' || n1 AS names, event_type || ' / ' || user_id AS label,
        nullif(q0 * price + q1 * price, 0) AS total FROM j""",
    "f01_item_filter": f"WITH {_RECORD} SELECT event_id FROM j WHERE event_type IN ('click', 'view', 'error') AND user_id > 20 AND user_id <= 120 AND 'paper' IN (n0, n1) AND price >= 10",
    "a20_completeness": f"""WITH {_FIELDS}, g AS (SELECT name, round(avg(organization) * 100, 1) AS organization, round(avg(price) * 100, 1) AS price, round(avg(deadline) * 100, 1) AS deadline, round(avg(region) * 100, 1) AS region, round(avg(source_url) * 100, 1) AS source_url FROM f GROUP BY 1)
        UNPIVOT g ON organization, price, deadline, region, source_url INTO NAME metric VALUE value""",
    "a21_quality_score": f"""WITH {_FIELDS}, g AS (SELECT name, round((avg(organization) * 0.3 + avg(price) * 0.3 + avg(deadline) * 0.2 + avg(region) * 0.1 + avg(source_url) * 0.1) * 100, 1) AS score, count(*) AS cnt FROM f GROUP BY 1)
        SELECT name, score, cnt, round(avg(score) OVER (), 2) AS overall FROM g""",
    "f17_demand_gate": f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR NOT regexp_matches(lower(text), '{DEMAND}') THEN 'no_demand' WHEN regexp_matches(lower(text), '{ADVERT}') THEN 'advert'
        WHEN coalesce(TRY_CAST(regexp_extract(lower(text), '([0-9]{{1,6}}) ?(ta|dona|шт|pcs)', 1) AS INT) < 50, false) THEN 'small' ELSE 'lead' END AS verdict FROM conversations""",
    "a41_document_frequency": """WITH w AS (SELECT row_number() OVER () AS rid, list_filter(regexp_extract_all(lower(text), '[a-zа-яёäöüßéèàçñóíáú'']+'), lambda w: length(w) > 2) AS w FROM conversations WHERE role = 'user'),
        t AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
        g AS (SELECT DISTINCT rid, 'unigram' AS kind, a AS gram FROM t UNION ALL SELECT DISTINCT rid, 'bigram', a || ' ' || b FROM t WHERE b IS NOT NULL)
        SELECT kind, gram, count(*) AS cnt FROM g GROUP BY kind, gram QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, gram) <= 15""",
    "a65_latest_by_section": "SELECT event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1",
    "p09_goods_title": """WITH x AS (SELECT l_orderkey, p_name, min(row(l_linenumber, p_name)) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
        r AS (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS n FROM x) SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY n) FILTER (WHERE n <= 2) AS title FROM r GROUP BY 1""",
    "p14_html_price": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN round(o_totalprice, 0) ELSE o_totalprice END AS price FROM orders",
}
