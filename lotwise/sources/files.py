"""Scans and sinks of saved feeds: JSON pages with receipts, JSON lines, CSV and text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_pages(spark: SparkSession, folder: str, path: str, item: str) -> DataFrame:
    """Items of saved responses, one file a page, with the page's file and the item's place: what paged requests collected.

    item is the items' schema as DDL; path leads to the array ('' if the response is one). An object at the path yields its
    values. The schema is given, so nothing is read twice, and a page that isn't JSON yields no items.
    """
    pages = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("page"), F.col("value").alias("body"))
    found = F.get_json_object("body", "$." + path if path else "$")
    rows = F.when(found.startswith("["), F.from_json(found, f"array<{item}>")).otherwise(F.map_values(F.from_json(found, f"map<string,{item}>")))
    return pages.select("page", F.posexplode(rows).alias("place", "item")).select("page", "place", "item.*")


def receipts(items: DataFrame) -> DataFrame:
    """One row a page: how many items, and a fingerprint of them that shows a repeated page."""
    values = [c for c in items.columns if c not in ("page", "place")]
    row = F.sha2(F.to_json(F.struct(*values)), 256)
    return items.groupBy("page").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(row)), ""), 256).alias("fingerprint"))


def completion(pages: DataFrame, page_size: int, page_cap: int | None = None) -> DataFrame:
    """One row: why collection ended. Only a short last page proves the archive's end; a fingerprint seen twice is a loop.

    page_cap: how many pages the collector asks for at most; None if it has no such limit, and then none can have ended it.
    """
    n = pages.agg(F.count("*").alias("pages"), F.count_distinct("fingerprint").alias("distinct_pages"), F.max_by("rows", "page").alias("last_rows"), F.sum("rows").alias("rows"))
    why = F.when(F.col("pages") == 0, "empty").when(F.col("distinct_pages") < F.col("pages"), "repeated_page").when(F.col("last_rows") < page_size, "archive_end")
    why = (why if page_cap is None else why.when(F.col("pages") >= page_cap, "page_cap")).otherwise("incomplete")
    return n.withColumn("completion", why).withColumn("complete", F.col("completion") == "archive_end")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that are no JSON are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv_export(rows: DataFrame, path: str) -> None:
    """CSV that spreadsheet programs read as UTF-8: each file begins with a byte order mark."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def csv_import(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV by a given schema, header and byte order mark skipped, text trimmed."""
    return spark.read.csv(path, schema=schema, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def column_widths(rows: DataFrame, most: int = 60) -> DataFrame:
    """(column, width): the longest value and two more, at most `most`."""
    widths = [F.least(F.greatest(F.max(F.length(F.col(c).cast("string"))), F.lit(len(c))) + 2, F.lit(most)).alias(c) for c in rows.columns]
    return rows.agg(*widths).unpivot([], rows.columns, "column", "width")


def text_digest(rows: DataFrame, by: str, line: Column, order: list[Column], most: int) -> DataFrame:
    """(by, digest): the first `most` lines of a group, and how many more there are."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", "_line")))), lambda x: x["_line"])
    more = F.when(F.count("*") > most, F.concat(F.lit("\n…and "), (F.count("*") - most).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select(F.col(by), line.alias("_line"), k.alias("_k")).groupBy(by).agg(F.concat(F.array_join(lines, "\n"), more).alias("digest"))
