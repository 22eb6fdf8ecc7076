"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A run is a table of (h1, h2, df), bucketed and sorted by the hash, that says in how many documents
of its batches a line was found. `settled` holds the hashes that reached the limit. A new batch is counted, merge-anti-joined
with the settled runs (their lines need no more counting) and added as a run of level 0; `fan_in` runs of a level are
compacted into one of the next, where hashes that reach the limit move to a settled run. All joins with runs are on the
bucketing columns, so runs are never shuffled again. In the end all levels are compacted once more, and a line goes if its
hash is settled: exactly the lines whose document count reaches the limit. The places of such lines are joined to their
documents; only documents that have any are shuffled.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, key_filter, marked_by_filter, materialise, new_path, path_of_store, spread_join

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIP)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    """128 bits: two hashes that share no seed."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


class Runs:
    """The levels of counted runs and the settled runs, each a bucketed table in the shared folder."""

    def __init__(self, spark, min_docs: int, fan_in: int):
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.written: list[tuple[str, str]] = []

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"lotwise_run_{uuid.uuid4().hex}"
        run = run.repartition(self.buckets, "h1", "h2")
        path = new_path(self.spark, "run")
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.written.append((name, path))
        return self.spark.table(name)

    def clear(self) -> None:
        """Drops the runs from the session's catalog and their files from the shared folder."""
        for name, path in self.written:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            where, store = path_of_store(self.spark, path)
            store.delete(where, True)
        self.written = []

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2), one row for each document and line key."""
        counted = batch.groupBy("h1", "h2").agg(F.count("*").alias("df"))
        for run in self.settled:
            counted = counted.join(run, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counted))
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_in:
                self._compact(level)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("df").alias("df"))

    def _compact(self, level: int) -> None:
        merged = materialise(self._merged(self.levels[level]), "compacted")
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged.filter(F.col("df") < self.min_docs)))
        self.settled.append(self._write(merged.filter(F.col("df") >= self.min_docs).select("h1", "h2")))
        discard(merged)
        self.levels[level] = []

    def frequent(self) -> DataFrame:
        """(h1, h2) of all lines that are in at least min_docs documents; each hash once."""
        last = self._merged([run for level in self.levels for run in level]).filter(F.col("df") >= self.min_docs).select("h1", "h2")
        return materialise(reduce(DataFrame.union, self.settled, last), "frequent")


def _places(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fan_in: int) -> DataFrame:
    """(doc_id, text_hash, places): where (from 0) a text has lines that are in at least min_docs documents."""
    text_hash = F.xxhash64("text").alias("text_hash")
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    again = (F.size(keys) > F.size(F.array_distinct(keys))).alias("again")
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_hash, batch, again, lines_of(F.col("text")).alias("lines"))
    split = rows.select("row", "doc_id", "text_hash", "batch", "again", F.posexplode("lines").alias("place", "line"))  # a row's id is made before its lines
    keyed = split.select("row", "doc_id", "text_hash", "batch", "again", "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hashed = keyed.select("row", "doc_id", "text_hash", "again", "place", key_hash(F.col("key")).alias("h"), "batch")
    hashed = materialise(hashed.select("row", "doc_id", "text_hash", "again", "place", "h.h1", "h.h2", "batch"), "lines", "batch")
    runs = Runs(docs.sparkSession, min_docs, fan_in)
    for b in range(batches):
        own = hashed.filter(F.col("batch") == b)
        repeats = own.filter("again").select("row", "h1", "h2").distinct().select("h1", "h2")  # a document counts once
        runs.add(own.filter("not again").select("h1", "h2").union(repeats))
    frequent = runs.frequent()
    runs.clear()
    places = spread_join(hashed.select("row", "doc_id", "text_hash", "place", "h1", "h2"), frequent, ["h1", "h2"], ["row"])
    out = materialise(places.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places")), "places")
    discard(hashed, frequent)
    return out


def _kept(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(row, lines, kept) of the documents that may lose lines, and (row) of the others; row is the whole row of docs."""
    places = _places(docs, min_docs, min_chars, batches, fan_in)
    key = F.xxhash64("doc_id", "text_hash").alias("key")
    wrapped = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    asked = marked_by_filter(wrapped.withColumn("key", key), "key", key_filter(places.select(key), "key"))
    ours, gone = asked.filter("_maybe"), places.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "places")
    joined = ours.join(gone, ours["doc_id"].eqNullSafe(gone["_i"]) & (ours["text_hash"] == gone["_h"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("places", F.array().cast("array<int>")))
    return joined.select("row", "lines", F.transform(left, lambda i: F.get("lines", i)).alias("kept")), asked.filter("not _maybe").select("row")


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs, for the lines that drop_repeated_lines leaves.

    A null or empty text is one empty line, which is never dropped. Rows that repeat give a row each, as do null doc_ids; a
    text may have any number of lines; further columns are ignored; an empty table gives an empty table.
    """
    touched, others = _kept(docs, min_docs, min_chars, batches, fan_in)
    doc_id, whole = F.col("row")["doc_id"].alias("doc_id"), F.coalesce(F.col("row")["text"], F.lit(""))
    size = F.size("lines").cast("long")
    cut = touched.select(doc_id, size.alias("n_lines"), (size - F.size("kept")).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))
    return cut.union(others.select(doc_id, F.size(lines_of(whole)).cast("long"), F.lit(0).cast("long"), F.sha2(whole, 256)))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """docs with the repeated lines cut out of text; other columns as they were, whatever their names.

    A null or empty text is one empty line, whose key has no code point, so it is never dropped (null becomes empty). A line is
    counted once a row, also where rows repeat a doc_id or it is null. An empty table gives an empty table.
    """
    touched, others = _kept(docs, min_docs, min_chars, batches, fan_in)
    cut = touched.select(F.col("row").withField("text", F.array_join("kept", "\n")).alias("row"))
    whole = others.select(F.col("row").withField("text", F.coalesce(F.col("row")["text"], F.lit(""))).alias("row"))
    return cut.union(whole).select("row.*")
