"""Feeds made of the driver's tables as saved pages, read back by cursor, by key and by what is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, table, written
from . import paging


def _cursors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages by customer: four feeds, each a chain from its least key that skips pages, ends with the archive, loops or breaks off."""
    k = F.col("c_custkey")
    after = F.when(k % 1499 == 0, F.lit(None)).when(k % 1201 == 0, k - 40).otherwise(k + 4 * (1 + k % 3))
    pages = table(spark, sf_dir, "customer").select((k % 4).alias("feed"), k.alias("cursor"), after.alias("next"))
    return pages, pages.groupBy("feed").agg(F.min("cursor").alias("cursor"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.cursor_pages(*_cursors(spark, sf_dir))


def _completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, starts = _cursors(spark, sf_dir)
    return paging.cursor_completion(pages, written(paging.cursor_pages(pages, starts), "placed"))


def _keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after the last one that was read, by (date, key), from saved files of which most need not be opened."""
    folder = new_path(spark, "pages")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), F.col("o_totalprice").alias("price"))
    paging.save_by_key(orders, "day", folder, 16)
    saved = paging.keyed_pages(spark, folder, "day", "o_orderkey long, day long, price double")
    return saved.filter(paging.after_key("day", "o_orderkey", F.lit(10200).cast("long"), F.lit(500).cast("long")))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of days that earlier runs hold: one a customer, of feeds by segment."""
    k, start = F.col("c_custkey"), F.lit("1995-01-01").cast("date")
    first = F.date_add(start, (k * 37 % 900).cast("int"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("feed"), first.alias("first"), F.date_add(first, (k % 5).cast("int") - 1).alias("last"))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("feed")).distinct()
    return paging.missing_spans(_held(spark, sf_dir), wanted.select("feed", F.lit("1995-02-01").cast("date").alias("first"), F.lit("1997-01-31").cast("date").alias("last")))


QUERIES = {
    "s04_cursor_pages": _placed,
    "s04_cursor_completion": _completion,
    "s11_keyset_scan": _keyset,
    "s17_held_spans": lambda spark, sf_dir: paging.merged_spans(_held(spark, sf_dir)),
    "s17_missing_spans": _missing,
}

_CHAIN = """RECURSIVE p AS (SELECT c_custkey % 4 AS feed, c_custkey AS cursor, CASE WHEN c_custkey % 1499 = 0 THEN NULL WHEN c_custkey % 1201 = 0 THEN c_custkey - 40 ELSE c_custkey + 4 * (1 + c_custkey % 3) END AS next FROM customer),
    r AS (SELECT feed, min(cursor) AS cursor, 0 AS place FROM p GROUP BY feed UNION ALL SELECT r.feed, q.cursor, r.place + 1 FROM r JOIN p ON p.feed = r.feed AND p.cursor = r.cursor JOIN p q ON q.feed = p.feed AND q.cursor = p.next WHERE r.place <= (SELECT count(*) FROM customer) // 2 + 40),
    c AS (SELECT feed, cursor, min(place) AS place FROM r GROUP BY ALL)"""
_SPANS = """h AS (SELECT feed, first, CAST(first + CAST(c_custkey % 5 - 1 AS INT) AS DATE) AS last FROM (SELECT c_mktsegment AS feed, c_custkey, CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 900 AS INT) AS DATE) AS first FROM customer WHERE c_custkey % 3 = 0)),
    d AS (SELECT DISTINCT feed, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM h WHERE first <= last)"""
_RUNS = "SELECT feed, CAST(min(day) AS DATE) AS first, CAST(max(day) AS DATE) AS last FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY feed ORDER BY day) AS INT) AS run FROM {days}) GROUP BY feed, run"
SQL = {
    "s04_cursor_pages": f"WITH {_CHAIN} SELECT feed, cursor, place FROM c",
    "s04_cursor_completion": f"""WITH {_CHAIN}, l AS (SELECT feed, count(*) AS pages, arg_max(cursor, place) AS last FROM c GROUP BY feed)
        SELECT l.feed, pages, last, CASE WHEN p.next IS NULL THEN 'archive_end' WHEN EXISTS (FROM c WHERE c.feed = l.feed AND c.cursor = p.next) THEN 'loop' ELSE 'missing_page' END AS completion FROM l JOIN p ON p.feed = l.feed AND p.cursor = l.last""",
    "s11_keyset_scan": "SELECT o_orderkey, day, price FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, o_totalprice AS price FROM orders) WHERE (day, o_orderkey) > (10200, 500)",
    "s17_held_spans": f"WITH {_SPANS} {_RUNS.format(days='d')}",
    "s17_missing_spans": f"""WITH {_SPANS}, w AS (SELECT DISTINCT c_mktsegment AS feed FROM customer), a AS (SELECT feed, CAST(unnest(generate_series(DATE '1995-02-01', DATE '1997-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM w),
        m AS (SELECT feed, day FROM a EXCEPT SELECT feed, day FROM d) {_RUNS.format(days='m')}""",
}
