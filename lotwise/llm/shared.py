"""Tables in the folder that driver and executors share, joins that hold hot keys, and bounded samples of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only when the session names no folder and runs on one machine.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Bits of a key filter: 4,096 rows of 4 KB, 16 MB whatever the table's size.
FILTER_BITS = 27
#: Tasks among which the rows of one key are dealt.
SALTS = 8
#: Bytes of the Arrow batches in which rows go to Python and back; a longer row goes alone.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets LOCAL_FOLDER."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lotwise/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet to the shared folder (in folders of the columns `by`) and read back: lineage ends here, and any executor may be lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lotwise_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of BATCH_BYTES, or of fewer bytes if the session says so.

    Spark's own 64 MB are held several times over in each task: as Arrow's growing buffers outside the executor's heap, which
    keep their size, and in the Python worker, as what it read, made and sent.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def once(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """The table that make() gives, written to path and read back; what an earlier call wrote there whole is only read."""
    where, store = path_of_store(spark, f"{path}/_SUCCESS")
    if not store.exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_of_store(spark: SparkSession, path: str):
    """The Hadoop path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes what `materialise` wrote, once nothing will read it again."""
    for df in tables:
        where, store = path_of_store(df.sparkSession, df.lotwise_path)
        store.delete(where, True)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of 2^FILTER_BITS bits of the hashes in column `key`: bounded, so that it may be broadcast."""
    slot = F.pmod(F.col(key), F.lit(1 << FILTER_BITS)) + 1
    held = keys.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_bit"))
    return held.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def marked_by_filter(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """df with _maybe: false only where no key of the bitmap has this hash."""
    slot = F.pmod(F.col(key), F.lit(1 << FILTER_BITS)) + 1
    asked = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return asked.join(F.broadcast(bitmap), "_bucket", "left").withColumn("_maybe", hit).drop("_bucket", "_bit", "_bits")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], deal: list[str], how: str = "inner", salts: int = SALTS, merge: bool = False) -> DataFrame:
    """many joined with one (few rows a key): a key's rows of `many` are dealt by the columns `deal` among `salts` tasks.

    With `merge`, `one` is never broadcast. Else it is if Spark takes it for small, which counts neither the `salts` copies of a
    row nor what compressed files unfold to: ten megabytes of files can be a gigabyte on the driver.
    """
    if merge:
        one = one.hint("merge")
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.withColumn("_salt", F.pmod(F.xxhash64(*deal), F.lit(salts)).cast("int"))
    return many.join(one, [*keys, "_salt"], how).drop("_salt")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def distinct_sample(df: DataFrame, keys: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """Rows of df that differ in `keys`, about `most` of them at most (for each value of the columns `by`, if given).

    Rows equal in `keys` count once, whichever of them stays. With more than `most`, those stay whose hash falls below the
    share that gives about 0.9 * most: the choice depends on the keys alone, so it is the same on every run and every
    executor, and a key that repeats, or is null, takes no more than its own place.
    """
    hashed = df.withColumn("_h", F.xxhash64(*keys, F.lit("sample")))
    grouped = hashed.groupBy(*by) if by else hashed.groupBy()
    n = grouped.agg(F.approx_count_distinct("_h", 0.02).alias("_n"))
    share = F.when(F.col("_n") > most, F.lit(float(1 << 30)) * 0.9 * most / F.col("_n")).otherwise(float(1 << 30))
    shares = n.select(*(by or []), share.alias("_share"))
    asked = hashed.join(shares, by) if by else hashed.crossJoin(F.broadcast(shares))  # one row
    chosen = asked.filter(F.pmod("_h", F.lit(1 << 30)) < F.col("_share"))
    return chosen.dropDuplicates(["_h", *(by or [])]).select(*df.columns)
