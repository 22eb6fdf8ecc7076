"""Session defaults for tests, benches and local use; a cluster brings its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lotwise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by the path that Spark's reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a local session that names none uses one of its own machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or 'file:///tmp/checkpoints').rstrip('/')}/lotwise/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing will read it again."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.lotwise_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its rows' places (from 1) in an order over the whole table, which ties must not leave open.

    Ranges of the order are sorted apart, and a row's place is its place in its range and the sizes of the ranges before it:
    no task holds more than a range, and what is broadcast is one row a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # the range's number above 33 bits of the place in it
    placed = placed.withColumn("_range", F.shiftright("_row", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return placed.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_row", "_range", "_before")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in a new folder that all executors share, read back: what follows doesn't repeat what came before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lotwise_path = path
    return out
