"""Saved responses of paged feeds: pages in the order of their cursors, keyset reads, and backfills that go on where others ended."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.graphs import list_places


def cursor_pages(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """(feed, cursor, place) of the pages that a feed's first cursor leads to, in their order.

    pages (feed, cursor, next); of a cursor that was saved several times the one that goes on furthest in order counts. A null
    next is the archive's end.
    """
    once = pages.groupBy("feed", "cursor").agg(F.max("next").alias("next"))
    links = once.select(F.col("feed").alias("list"), F.col("cursor").alias("node"), "next")
    return list_places(links, starts.select(F.col("feed").alias("list"), F.col("cursor").alias("node"))).select(F.col("list").alias("feed"), F.col("node").alias("cursor"), "place")


def cursor_completion(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """(feed, pages, last, completion): whether a feed's pages end with the archive, run in a loop, or lack the next page."""
    ends = placed.groupBy("feed").agg(F.count("*").alias("pages"), F.max_by("cursor", "place").alias("last"))
    after = pages.groupBy("feed", F.col("cursor").alias("last")).agg(F.max("next").alias("next"))
    known = placed.select("feed", F.col("cursor").alias("next"), F.lit(True).alias("seen"))
    why = F.when(F.col("next").isNull(), "archive_end").when(F.col("seen"), "loop").otherwise("missing_page")
    # One row a feed asks tables of all pages: those aren't broadcast.
    return ends.join(after.hint("merge"), ["feed", "last"]).join(known.hint("merge"), ["feed", "next"], "left").select("feed", "pages", "last", why.alias("completion"))


def after_key(time: str, key: str, last_time: Column, last_key: Column) -> Column:
    """Strictly after (last_time, last_key) in the order of (time, key): rows that share the last time are not lost.

    The first condition says nothing new, but a source can be asked for it.
    """
    return (F.col(time) >= last_time) & ((F.col(time) > last_time) | (F.col(key) > last_key))


def save_by_key(rows: DataFrame, key: str, folder: str, files: int) -> None:
    """rows as files of JSON lines, each of a range of the key, which its name says: <least>_<greatest>.jsonl."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        rows_, least, greatest = [], None, None
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows_.append(line)
                least, greatest = (k, k) if least is None else (min(least, k), max(greatest, k))
        if rows_:  # written beside and then renamed: a task that is run again replaces its own file
            name = posixpath.join(root, f"{least}_{greatest}.jsonl")
            with store.open_output_stream(name + ".part") as out:
                out.write(("\n".join(rows_) + "\n").encode())
            store.move(name + ".part", name)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows_)], pa.int64())], names=["n"])

    dealt = rows.filter(F.col(key).isNotNull()).repartitionByRange(files, key).select(F.col(key).cast("long"), F.to_json(F.struct("*")))
    dealt.mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one row


class Range(InputPartition):
    def __init__(self, path: str):
        self.path = path


class KeyedPages(DataSource):
    """Format "keyed_pages": JSON lines that `save_by_key` left at the option `path`, with the option `key` as their key.

    Comparisons of the key with a number are taken from the plan and decide which files are read at all; they are asked of
    each row of these files again. JSON files say nothing of what they hold, so Spark's own reader would read them all.
    """

    @classmethod
    def name(cls) -> str:
        return "keyed_pages"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema):
        return KeyedReader(self.options, schema)


class KeyedReader(DataSourceReader):
    TESTS = {
        EqualTo: lambda lo, hi, v: lo <= v <= hi, GreaterThan: lambda lo, hi, v: hi > v, GreaterThanOrEqual: lambda lo, hi, v: hi >= v,
        LessThan: lambda lo, hi, v: lo < v, LessThanOrEqual: lambda lo, hi, v: lo <= v,
    }

    def __init__(self, options, schema):
        self.path, self.key, self.names, self.asked = options["path"], options["key"], [f.name for f in schema.fields], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if type(one) in self.TESTS and one.attribute == (self.key,) and isinstance(one.value, int):
                self.asked.append(one)
            else:
                yield one

    def partitions(self) -> list[Range]:
        store, root = pafs.FileSystem.from_uri(self.path)
        out = []
        for info in store.get_file_info(pafs.FileSelector(root)):
            if info.base_name.endswith(".jsonl"):
                lo, hi = map(int, info.base_name.removesuffix(".jsonl").split("_"))
                if all(self.TESTS[type(f)](lo, hi, f.value) for f in self.asked):
                    out.append(Range(info.path))
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                row = json.loads(line)
                k = row.get(self.key)
                if all(self.TESTS[type(a)](k, k, a.value) for a in self.asked):
                    yield tuple(row.get(n) for n in self.names)


def keyed_pages(spark: SparkSession, folder: str, key: str, fields: str) -> DataFrame:
    """The rows that `save_by_key` saved; conditions on the key leave out the files that hold none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyedPages)
    return spark.read.format("keyed_pages").option("key", key).option("fields", fields).load(folder)


def merged_spans(spans: DataFrame, by: str = "feed") -> DataFrame:
    """(by, first, last): held ranges of days, those that overlap or adjoin as one; a range whose ends are null or crossed is none."""
    order = Window.partitionBy(by).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col("first") > F.date_add(reach, 1))).cast("int")
    kept = spans.filter("first <= last").select(by, "first", "last").withColumn("_begins", begins)
    return kept.withColumn("_span", F.sum("_begins").over(order)).groupBy(by, "_span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_span")


def missing_spans(held: DataFrame, wanted: DataFrame, by: str = "feed") -> DataFrame:
    """(by, first, last): what a backfill still has to fetch of the wanted ranges (by, first, last; one a feed), the newest first in line."""
    inside = wanted.select(by, F.col("first").alias("_a"), F.col("last").alias("_z")).join(merged_spans(held, by), by, "left")
    inside = inside.filter("first is null or (last >= _a and first <= _z)").union(wanted.select(by, F.col("first"), F.col("last"), F.date_add("last", 1), F.date_add("last", 1)))
    met = inside.filter("first is not null")
    before = F.lag("last").over(Window.partitionBy(by).orderBy("first", "last"))
    gap = met.select(by, F.greatest("_a", F.coalesce(F.date_add(before, 1), F.col("_a"))).alias("_from"), F.least("_z", F.date_sub("first", 1)).alias("_to"))
    return gap.filter("_from <= _to").select(by, F.col("_from").alias("first"), F.col("_to").alias("last"))


def page_span(pages: DataFrame, since: Column) -> DataFrame:
    """(feed, first, last) that saved pages (feed, place, oldest, newest, rows) prove to be held.

    Pages go from new to old without a gap from place 0 on; the day of the oldest row is only known to be whole if a later
    page reaches an older day, the archive ended (a page without rows), or the boundary is passed.
    """
    order = Window.partitionBy("feed").orderBy("place")
    run = pages.withColumn("_gap", (F.col("place") != F.row_number().over(order) - 1).cast("int")).withColumn("_gap", F.max("_gap").over(order)).filter("_gap = 0")
    sums = run.groupBy("feed").agg(F.min("oldest").alias("oldest"), F.max("newest").alias("last"), F.max((F.col("rows") == 0).cast("int")).alias("ended"))
    first = F.when((F.col("ended") == 1) | (F.col("oldest") < since), since).otherwise(F.date_add("oldest", 1))
    return sums.filter("last is not null").select("feed", first.alias("first"), "last").filter("first <= last")
