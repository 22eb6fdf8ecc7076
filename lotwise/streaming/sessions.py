"""Streams of activity: sessions whose gap is a source's own rhythm, sliding comparisons with late rows, keyed outboxes, probes."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import discard, written
from .monitor import FACTOR, HIGH, LOW, NEEDED

#: Hours of silence that end a session of a source whose rhythm isn't known.
UNKNOWN = 24.0


def rhythm(history: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, hours): the silence that is normal for a source, from the median of the gaps of its history, within LOW to HIGH.

    Sources of fewer than NEEDED gaps have the hours of UNKNOWN. The median is the higher of two middle gaps.
    """
    before = F.lag(ts).over(Window.partitionBy(by).orderBy(ts))
    gaps = history.select(by, ((F.unix_micros(ts) - F.unix_micros(before)) / 3_600_000_000.0).alias("gap")).filter("gap > 0")
    counts = gaps.groupBy(by, "gap").agg(F.count("*").alias("n"))  # no list of a source's gaps, however many there are
    order = Window.partitionBy(by).orderBy("gap")
    placed = counts.select(by, "gap", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(by)).alias("all"))
    median = placed.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(by).agg(F.min("gap").alias("median"), F.max("all").alias("all"))
    known = F.when(F.col("all") >= NEEDED, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), FACTOR * F.col("median")))).otherwise(UNKNOWN)
    return history.select(by).distinct().join(median, by, "left").select(by, F.coalesce(known, F.lit(UNKNOWN)).alias("hours"))


def rhythm_sessions(rows: DataFrame, rhythms: DataFrame, by: str, ts: str, lag: str = "1 hour") -> DataFrame:
    """(by, begins, ends, cnt): runs of rows of a source that no silence longer than its rhythm parts; rows may be a stream.

    `ends` is the last row's time and its source's rhythm. rhythms (by, hours) is a table; sources that it lacks have UNKNOWN.
    A row that comes up to `lag` late still joins two sessions that lie around it.
    """
    told = rows.join(rhythms, by, "left").withColumn("_gap", F.concat((F.coalesce("hours", F.lit(UNKNOWN)) * 3600).cast("long").cast("string"), F.lit(" seconds")))
    told = told.withWatermark(ts, lag) if rows.isStreaming else told
    return told.groupBy(by, F.session_window(ts, F.col("_gap"))).agg(F.count("*").alias("cnt")).select(by, F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "cnt")


def sliding(rows: DataFrame, by: str, ts: str, width: str, slide: str, lag: str) -> DataFrame:
    """(window, by, cnt) of overlapping windows."""
    kept = rows.withWatermark(ts, lag) if rows.isStreaming else rows
    return kept.groupBy(F.window(ts, width, slide), by).agg(F.count("*").alias("cnt"))


def base_and_recent(base: DataFrame, recent: DataFrame, by: str, days: int, recent_days: int) -> DataFrame:
    """(by, ends, base, recent, change): of windows that end together the rows a day of the long and of the short one.

    base and recent come from `sliding` over days and recent_days; both may be streams, which are joined by window and source.
    """
    long = base.select(F.col(by).alias("_by"), F.col("window.end").alias("_ends"), "window", F.col("cnt").alias("_cnt"))
    joined = recent.select(by, F.col("window.end").alias("ends"), "cnt").join(long, (F.col(by) == F.col("_by")) & (F.col("ends") == F.col("_ends")))
    per = lambda c, n: F.col(c) / F.lit(float(n))
    return joined.select(by, "ends", per("_cnt", days).alias("base"), per("cnt", recent_days).alias("recent"), F.round(per("cnt", recent_days) / per("_cnt", days) - 1, 6).alias("change"))


class Outbox:
    """Rows by key that wait for delivery: pending ones of earlier runs and the current ones, of which the current win.

    The folder holds numbered versions (rows and a manifest that is written last) and one receipt file a delivered batch. A
    version without its manifest was never committed. A key is delivered when a receipt names it with the row's content, so a
    crash between sending and committing sends nothing twice, and one before sending loses nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self.store = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        if not self.store.exists(self.path("rows")):
            return []
        names = [s.getPath().getName() for s in self.store.listStatus(self.path("rows"))]
        return sorted(int(n) for n in names if self.store.exists(self.path(f"rows/{n}/_SUCCESS")))

    def pending(self) -> DataFrame | None:
        """The rows of the last version that was committed; None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.folder}/rows/{versions[-1]}") if versions else None

    def _delivered(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, content) of what receipts name."""
        if not self.store.exists(self.path("receipts")):
            return rows.select(key, "_content").limit(0)
        return self.spark.read.schema(rows.select(key, "_content").schema).parquet(f"{self.folder}/receipts").distinct()

    def merge(self, current: DataFrame, key: str) -> DataFrame:
        """Commits a new version: current rows, and pending ones of other keys, without what was delivered. Returns it.

        Of current rows that repeat a key one is kept; rows without a key are left out.
        """
        values = [c for c in current.columns if c != key]
        content = F.sha2(F.to_json(F.struct(*values)), 256).alias("_content")
        ours = current.filter(F.col(key).isNotNull()).select("*", content).groupBy(key).agg(F.min(F.struct("_content", *values)).alias("row")).select(key, "row.*")
        before = self.pending()
        if before is not None:
            ours = ours.unionByName(before.join(ours.select(key), key, "left_anti"))
        kept = ours.join(self._delivered(ours, key), [key, "_content"], "left_anti").select(key, "_content", *values)
        number = (self._versions() or [0])[-1] + 1
        kept.write.mode("overwrite").parquet(f"{self.folder}/rows/{number}")  # its _SUCCESS is the manifest
        return self.pending()

    def deliver(self, key: str, send: Callable[[DataFrame], bool], batches: int) -> int:
        """Sends what is pending, dealt by key into batches; after each that was taken its receipt. Stops at the first that fails.

        Returns how many batches were taken. send is given a DataFrame of rows; what it returned True for is never sent again.
        """
        rows = self.pending()
        for b in range(batches):
            part = rows.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
            part = part.join(self._delivered(rows, key), [key, "_content"], "left_anti")
            if part.isEmpty():
                continue
            batch = written(part, "batch")
            try:
                taken = send(batch.drop("_content"))
            except Exception:  # a failed delivery is an outcome: what was confirmed before stays confirmed
                taken = False
            if not taken:
                discard(batch)
                return b
            batch.select(key, "_content").write.mode("append").parquet(f"{self.folder}/receipts")
            discard(batch)
        return batches


class Numbers(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class Probe(DataSource):
    """Format "probe": records by consecutive numbers, each a file <number>.json in the option `path`, as a stream.

    The offset is the next number and those that wait: records that weren't final when they were read (option `pending`: the
    states that aren't) and numbers below the highest found that had none. They are asked again by every batch until they
    are final or were asked by `tries` batches (then they are given as they are). A batch goes on until `misses` numbers in a
    row are not there, and no further than `most` numbers. Spark logs the offsets of a batch before it runs, and the source
    keeps the last ones in the option `state`, so a run that was stopped goes on with the same numbers: none is lost or repeated.
    """

    @classmethod
    def name(cls) -> str:
        return "probe"

    def schema(self) -> str:
        return "id long, state string, title string"

    def streamReader(self, schema):
        return ProbeReader(self.options)


class ProbeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.store, self.root = pafs.FileSystem.from_uri(options["path"])
        self.uri, self.kept = options["path"], posixpath.join(pafs.FileSystem.from_uri(options["state"])[1], "offset.json")
        self.first = int(options.get("start", "1"))
        self.misses, self.most, self.tries = (int(options.get(k, d)) for k, d in (("misses", "5"), ("most", "1000"), ("tries", "20")))
        self.unfinished = set(options.get("pending", "").split(","))

    def initialOffset(self) -> dict:
        return {"next": self.first, "waiting": "{}"}

    def _json(self, path: str) -> dict | None:
        if self.store.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _final(self, number: int) -> bool:
        record = self._json(posixpath.join(self.root, f"{number}.json"))
        return record is not None and record.get("state") not in self.unfinished

    def _ahead(self, start: int) -> tuple[int, bool]:
        """The number after the last one that is there, as far as one batch goes, and whether the next batch goes on from there."""
        at, missed, end = start, 0, start
        while missed < self.misses and at - start < self.most:
            there = self.store.get_file_info(posixpath.join(self.root, f"{at}.json")).type != pafs.FileType.NotFound
            at, missed = at + 1, 0 if there else missed + 1
            end = at if there else end
        return end, missed < self.misses and end > start

    def latestOffset(self) -> dict:
        last = self._json(self.kept) or self.initialOffset()
        was = {int(k): v for k, v in json.loads(last["waiting"]).items()}
        end, more = self._ahead(last["next"])
        waiting = (was if more else {k: v + 1 for k, v in was.items() if not self._final(k)}) | {k: 0 for k in range(last["next"], end) if not self._final(k)}
        if end == last["next"] and waiting.keys() == was.keys():
            return last  # nothing new: no batch
        return {"next": end, "waiting": json.dumps({str(k): v for k, v in sorted(waiting.items()) if v < self.tries})}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        self.store.create_dir(posixpath.dirname(self.kept), recursive=True)
        with self.store.open_output_stream(self.kept + ".part") as f:
            f.write(json.dumps(end).encode())
        self.store.move(self.kept + ".part", self.kept)
        was, now = json.loads(start["waiting"]), json.loads(end["waiting"])
        asked = [int(k) for k in was if k not in now] + [n for n in range(start["next"], end["next"]) if str(n) not in now]
        return [Numbers(asked[i : i + 100]) for i in range(0, len(asked), 100)] or [Numbers([])]

    def read(self, partition: Numbers) -> Iterator[tuple]:
        for number in partition.numbers:
            record = self._json(posixpath.join(self.root, f"{number}.json"))
            if record is not None:
                yield number, record.get("state"), record.get("title")

    def commit(self, end: dict) -> None:
        """Nothing to let go of: records stay where they are."""


def probe(spark: SparkSession, folder: str, state: str, **options: str) -> DataFrame:
    """The final records (id, state, title) of a folder as a stream; `state` is a folder of the shared store."""
    spark.dataSource.register(Probe)
    reader = spark.readStream.format("probe").option("path", folder).option("state", state)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()

