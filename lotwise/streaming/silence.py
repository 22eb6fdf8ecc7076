"""The silence monitor by window functions: a batch of observations and the sources' states give changes and the next states.

It follows `monitor.advance` row by row, but no source's rows are ever held together in Python: runs of zeros are islands
between rows with data, and what a row needs of the rows before it (cycles, zeros in a row, the last data, the last gaps,
whether this streak has told) are running counts. A busy source is one sorted partition, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .monitor import FACTOR, GRACE, HIGH, KEPT, LOW, NEEDED, ZEROS

STATE = "source string, cycles int, zeros int, last double, gaps array<double>, alerted boolean"


def silence_changes(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (source, at, outcome), state (STATE) -> (source, at, kind, zeros) of alerts and recoveries, and the states after the rows.

    outcome: data, empty, error, or skipped, which changes nothing. Rows of one time go in the order of their outcomes. Rows
    without a source or a time are left out; sources without rows keep their states.
    """
    order = Window.partitionBy("source").orderBy("at", "outcome", "row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = state.select("source", *[F.col(c).alias(f"was_{c}") for c in ("cycles", "zeros", "last", "gaps", "alerted")])
    seen = rows.filter("source is not null and at is not null and outcome <> 'skipped'").select("source", "at", "outcome", F.monotonically_increasing_id().alias("row"))
    joined = seen.join(known, "source", "left").withColumn("hours", F.unix_micros(F.col("at").cast("timestamp")) / 3_600_000_000.0).withColumn("data", F.col("outcome") == "data")
    data_hours = F.when(F.col("data"), F.col("hours"))
    placed = joined.select(
        "*", F.row_number().over(order).alias("n"), F.sum(F.col("data").cast("int")).over(order).alias("island"),
        F.coalesce(F.last(data_hours, ignorenulls=True).over(before), F.col("was_last")).alias("last"),
    )
    gap = F.when(F.col("data") & (F.col("hours") > F.col("last")), F.round(F.col("hours") - F.col("last"), 2))
    placed = placed.withColumn("gap", gap).withColumn("gi", F.count("gap").over(order))
    # The last gaps after each new gap; rows find them by how many gaps came before.
    by_gap = Window.partitionBy("source").orderBy("gi")
    new = F.array_compact(F.array(*[F.lag("gap", k).over(by_gap) for k in range(KEPT - 1, 0, -1)], F.col("gap")))
    gaps = placed.filter("gap is not null").select("source", "gi", new.alias("new"))
    both = placed.join(gaps, ["source", "gi"], "left")
    all_ = F.concat(F.coalesce("was_gaps", F.array().cast("array<double>")), F.coalesce("new", F.array().cast("array<double>")))
    both = both.withColumn("gaps", F.slice(all_, F.greatest(F.size(all_) - KEPT + 1, F.lit(1)), KEPT))
    good = F.array_sort(F.filter("gaps", lambda g: g > 0))
    limit = F.when(F.size(good) >= NEEDED, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), FACTOR * F.get(good, F.floor(F.size(good) / 2).cast("int")))))
    within = Window.partitionBy("source", "island").orderBy("at", "outcome", "row")
    first = F.col("island") == 0
    both = both.withColumn("zeros", F.count(F.when(~F.col("data"), 1)).over(within) + F.when(first, F.coalesce("was_zeros", F.lit(0))).otherwise(0))
    cycles = F.col("n") + F.coalesce("was_cycles", F.lit(0))
    long = F.when(limit.isNull() | F.col("last").isNull(), F.col("zeros") >= ZEROS).otherwise(F.col("hours") - F.col("last") >= limit)
    both = both.withColumn("met", (~F.col("data") & (cycles >= GRACE) & long).cast("int"))
    told = first & F.coalesce("was_alerted", F.lit(False))
    both = both.withColumn("mets", F.sum("met").over(within)).withColumn("all_mets", F.coalesce(F.sum("met").over(before), F.lit(0))).withColumn("at_data", F.when(F.col("data"), F.col("all_mets")))
    alert = (F.col("met") == 1) & (F.col("mets") == 1) & ~told
    was = F.last("at_data", ignorenulls=True).over(before)
    recovery = F.col("data") & ((F.col("all_mets") > F.coalesce(was, F.lit(0))) | (was.isNull() & F.coalesce("was_alerted", F.lit(False))))
    both = both.withColumn("kind", F.when(alert, "alert").when(recovery, "recovery"))
    ended = both.select("source", "n", cycles.alias("cycles"), "zeros", F.when(F.col("data"), F.col("hours")).otherwise(F.col("last")).alias("last"), "gaps", ((F.col("mets") > 0) | told).alias("alerted"))
    after = ended.groupBy("source").agg(F.max_by(F.struct("cycles", "zeros", "last", "gaps", "alerted"), "n").alias("s")).select("source", *[F.col(f"s.{c}").cast(t).alias(c) for c, t in (("cycles", "int"), ("zeros", "int"), ("last", "double"), ("gaps", "array<double>"), ("alerted", "boolean"))])
    rest = state.join(after.select("source"), "source", "left_anti").select(after.columns)
    return both.filter("kind is not null").select("source", "at", "kind", F.col("zeros").cast("int").alias("zeros")), after.unionByName(rest)


def silence_stream(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of observations to the end of what is there: changes and states lie in the folder by batch, and are returned.

    A batch that is run again reads the state before it and replaces what it had written.
    """
    spark: SparkSession = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(STATE).parquet(f"{folder}/state/{number - 1}") if number else spark.createDataFrame([], STATE)
        seen = batch.persist()
        changes, state = silence_changes(seen, old)
        changes.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        state.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        seen.unpersist()

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("source", "at", "kind", "zeros")
