"""The silence monitor over files that arrive one after the other, against the same steps in plain Python."""

from datetime import datetime, timedelta

from lotwise.streaming import monitor


def test_state_goes_on_between_batches(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    outcomes = ["data", "empty", "data", "data", "empty", "empty", "skipped", "empty", "error", "data", "empty"]
    hours = [0, 2, 6, 12, 14, 20, 21, 40, 60, 80, 81]
    rows = [("a", begin + timedelta(hours=h), o) for h, o in zip(hours, outcomes, strict=True)] + [("b", begin + timedelta(hours=h), "empty") for h in hours]
    for k, part in enumerate((rows[:6], rows[6:15], rows[15:])):
        spark.createDataFrame(part, "source string, at timestamp, outcome string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("source string, at timestamp, outcome string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = monitor.run_to_end(monitor.silence_monitor(stream), "append", f"{tmp_path}/run").collect()
    want, state = [], {}
    for source, at, outcome in rows:
        hour = (at - datetime(1970, 1, 1)).total_seconds() / 3600
        state[source], kind = monitor.advance(state.get(source, (0, 0, None, [], False)), hour, outcome)
        if kind:
            want.append((source, at, kind))
    assert sorted((r.source, r["at"], r.kind) for r in got) == sorted(want)
    assert {k for s, _, k in want if s == "a"} == {"alert", "recovery"} and [k for s, _, k in want if s == "b"] == ["alert"]
