"""Structured Streaming: tumbling windows, late repeats, delivery once, and the silence monitor of sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Cycles before a source may alarm, zeros in a row without a known rhythm, gaps kept, gaps needed, hours.
GRACE, ZEROS, KEPT, NEEDED, FACTOR, LOW, HIGH = 3, 3, 5, 2, 2.5, 6.0, 336.0
STATE = "cycles int, zeros int, last_data double, gaps array<double>, alerted boolean"
CHANGES = "source string, at timestamp, kind string, zeros int"


def windowed(rows: DataFrame, ts: str, by: str, width: str = "3 days", lag: str = "30 minutes") -> DataFrame:
    """Counts by tumbling window and group; rows later than the lag behind the newest are left out of closed windows."""
    grouped = rows.withWatermark(ts, lag).groupBy(F.window(ts, width), F.col(by).alias("name"))
    return grouped.agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("begins"), F.col("window.end").alias("ends"), "name", "cnt")


def first_seen(rows: DataFrame, keys: list[str], ts: str, lag: str = "14 days") -> DataFrame:
    """Each key once; a repeat within the lag is dropped, and what is older is forgotten."""
    return rows.withWatermark(ts, lag).dropDuplicatesWithinWatermark(keys)


def allowed_silence(gaps: list[float]) -> float | None:
    """Hours of silence that are normal for a source; None while its rhythm is unknown."""
    good = sorted(g for g in gaps if g > 0)
    return max(LOW, min(HIGH, FACTOR * good[len(good) // 2])) if len(good) >= NEEDED else None


def advance(state: tuple, at: float, outcome: str) -> tuple[tuple, str | None]:
    """The next state of a source after one observation at `at` (hours), and what to tell: alert, recovery or nothing.

    outcome: data, empty, error, or skipped, which changes nothing. An alert comes once a streak of zeros, after the grace
    cycles, when the silence is longer than the source's rhythm allows (or after ZEROS zeros if that is unknown).
    """
    cycles, zeros, last, gaps, alerted = state
    if outcome == "skipped":
        return state, None
    cycles += 1
    if outcome == "data":
        if last is not None and at > last:
            gaps = [*gaps, round(at - last, 2)][-KEPT:]
        return (cycles, 0, at, gaps, False), "recovery" if alerted else None
    zeros += 1
    limit = allowed_silence(gaps)
    long = zeros >= ZEROS if limit is None or last is None else at - last >= limit
    told = cycles >= GRACE and not alerted and long
    return (cycles, zeros, last, gaps, alerted or told), "alert" if told else None


def silence_monitor(rows: DataFrame) -> DataFrame:
    """rows (source string, at timestamp, outcome string), streaming -> the alerts and recoveries of every source.

    The state of a source is a few numbers; the rows of a batch are sorted within it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, None, [], False)
        now = (*now[:3], list(now[3]), now[4])
        told = []
        for r in pd.concat(parts).sort_values(["at", "outcome"]).itertuples():
            now, kind = advance(now, r.at.timestamp() / 3600, r.outcome)
            if kind:
                told.append((key[0], r.at, kind, now[1]))
        state.update(now)
        yield pd.DataFrame(told, columns=["source", "at", "kind", "zeros"])

    return rows.groupBy("source").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def deliver_once(rows: DataFrame, path: str, checkpoint: str):
    """A streaming write that leaves each batch in a folder of its number: a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(rows: DataFrame, mode: str, folder: str) -> DataFrame:
    """Everything that a streaming DataFrame gives over what is there now, as a table in the folder."""
    spark: SparkSession = rows.sparkSession
    if mode == "append":
        deliver_once(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    else:

        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out") if mode != "append" else spark.read.parquet(f"{folder}/out").select(*rows.columns)
