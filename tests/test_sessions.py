"""Sessions by rhythm, sliding comparisons, outbox and probe, as streams over several files."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lotwise.session import new_path
from lotwise.streaming import monitor, sessions

T0 = datetime(2024, 1, 1)
at = lambda h: T0 + timedelta(hours=h)


def streamed(spark, parts, schema, folder):
    """A stream of several files, one a batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_rhythm_is_the_median_gap(spark):
    rows = [("a", at(h)) for h in (0, 4, 8, 20)] + [("b", at(h)) for h in range(0, 400, 100)] + [("c", at(0)), ("c", at(0)), ("c", at(1))]
    got = {r.s: r.hours for r in sessions.rhythm(spark.createDataFrame(rows, "s string, t timestamp"), "s", "t").collect()}
    assert got == {"a": 10.0, "b": 250.0, "c": sessions.UNKNOWN}


def test_sessions_of_own_gaps(spark):
    hours = {"a": [0, 2, 5, 30, 31], "b": [0, 90, 300], "new": [0, 20, 50]}
    gap = {"a": 6.0, "b": 100.0, "new": sessions.UNKNOWN}
    rows = [(s, at(h)) for s, hs in hours.items() for h in hs]
    late = [rows[1:4] + rows[5:7], [rows[0]] + rows[7:9], [rows[4], ("a", at(4))], rows[9:]]
    want = set()
    for s, hs in hours.items():
        hs = sorted(hs + ([4] if s == "a" else []))
        first, last, n = hs[0], hs[0], 0
        for h in [*hs, None]:
            if h is None or h > last + gap[s]:
                want.add((s, at(first), at(last + gap[s]), n))
                first, n = h, 0
            last, n = h, n + 1
    table = spark.createDataFrame([("a", 6.0), ("b", 100.0)], "s string, hours double")
    folder = new_path(spark, "sessions")
    for df in (spark.createDataFrame(rows + [("a", at(4))], "s string, t timestamp"), streamed(spark, late, "s string, t timestamp", folder)):
        out = sessions.rhythm_sessions(df, table, "s", "t", "1000 hours")
        rows_ = monitor.run_to_end(out, "complete", folder).collect() if df.isStreaming else out.collect()
        assert {tuple(r) for r in rows_} == want


def test_base_and_recent_with_late_files(spark):
    days = [(s, at(24 * d + h)) for d in range(12) for s, n in (("a", 3), ("b", 1 + d % 3)) for h in range(n)]
    parts = [days[:20], days[25:40], days[20:25], days[40:], [("a", at(24 * 40))], [("a", at(24 * 80))]]  # the third comes late, the last only close windows
    folder = new_path(spark, "sliding")
    stream = streamed(spark, parts, "s string, t timestamp", folder)
    make = lambda df: sessions.base_and_recent(sessions.sliding(df, "s", "t", "4 days", "1 day", "10 days"), sessions.sliding(df, "s", "t", "2 days", "1 day", "10 days"), "s", 4, 2)
    got = {tuple(r) for r in monitor.run_to_end(make(stream), "append", folder).collect()}
    all_ = {tuple(r) for r in make(spark.createDataFrame(sum(parts, []), "s string, t timestamp")).collect()}
    closed = {r for r in all_ if r[1] <= at(24 * 30)}
    assert closed and closed <= got and got <= all_


def test_outbox_survives_crashes(spark):
    folder, schema = new_path(spark, "outbox"), "k string, v int"
    sent = []

    def send(rows):
        sent.extend((r.k, r.v) for r in rows.collect())
        return True

    def broken(rows):
        raise OSError("no line")

    box = sessions.Outbox(spark, folder)
    first = [(f"k{i}", i) for i in range(20)]
    box.merge(spark.createDataFrame(first + [(None, 1), ("k3", 3)], schema), "k")
    assert box.deliver("k", broken, 4) == 0 and not sent
    half = lambda rows: send(rows) if len(sent) < 8 else broken(rows)
    taken = box.deliver("k", half, 4)
    assert 0 < taken < 4 and 0 < len(sent) < 20
    before = set(sent)
    # A new process: rows that changed win over pending ones, what was delivered doesn't come again unless it changed.
    changed = next(k for k, _ in before)
    box = sessions.Outbox(spark, folder)
    os.makedirs(f"{folder.removeprefix('file://')}/rows/99", exist_ok=True)  # a version that was never committed
    box.merge(spark.createDataFrame([(changed, 500), ("k19", 19), ("new", 1)], schema), "k")
    assert box.deliver("k", send, 4) == 4
    assert len(sent) == len(set(sent)) and set(sent) == set(first) | {(changed, 500), ("new", 1)}
    assert box.merge(spark.createDataFrame([], schema), "k").count() == 0 and box.deliver("k", broken, 4) == 4


def test_probe_goes_on_where_it_stopped(spark):
    folder = new_path(spark, "probe").removeprefix("file://")
    os.makedirs(f"{folder}/in")
    put = lambda n, state: open(f"{folder}/in/{n}.json", "w").write(json.dumps({"state": state, "title": f"t{n}"}))

    def run(fail=False):
        def sink(batch, number):
            rows = batch.select("id", "state")
            if fail:
                raise OSError("stopped")
            rows.write.mode("overwrite").parquet(f"file://{folder}/out/batch={number}")

        stream = sessions.probe(spark, f"file://{folder}/in", f"file://{folder}/state", pending="review", misses="3", most="50")
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{folder}/checkpoint").start()
        try:
            query.processAllAvailable()
        except Exception:
            assert fail
        query.stop()

    for n in (1, 2, 4, 5, 7):
        put(n, "review" if n == 4 else "open")
    run()
    put(9, "open")
    put(4, "open")
    run(fail=True)  # the batch's offsets are logged, its rows are not written
    put(3, "open")  # a lower number that comes late
    put(20, "open")  # too far ahead: numbers before it are missing
    run()
    put(6, "review")
    run()
    put(6, "open")
    run()
    got = [(r.id, r.state) for r in spark.read.parquet(f"file://{folder}/out").collect()]
    assert sorted(got) == [(n, "open") for n in (1, 2, 3, 4, 5, 6, 7, 9)]


def test_probe_of_many_batches_is_one_try(spark):
    """What isn't final waits however many batches the way to the end takes, and is given once it is final."""
    folder = new_path(spark, "probe").removeprefix("file://")
    os.makedirs(f"{folder}/in")
    put = lambda n, state: open(f"{folder}/in/{n}.json", "w").write(json.dumps({"state": state, "title": f"t{n}"}))

    def run():
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"file://{folder}/out/batch={number}")
        stream = sessions.probe(spark, f"file://{folder}/in", f"file://{folder}/state", pending="review", misses="3", most="2", tries="3")
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{folder}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.id, r.state) for r in spark.read.parquet(f"file://{folder}/out").collect())

    for n in range(1, 13):
        put(n, "review" if n in (2, 5) else "open")
    others = [(n, "open") for n in range(1, 13) if n not in (2, 5)]
    assert run() == others
    put(2, "open")
    assert run() == sorted([*others, (2, "open")])
