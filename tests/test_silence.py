"""The silence monitor by windows against the rule of single observations, over several batches."""

import random
from datetime import datetime, timedelta

from lotwise.session import new_path
from lotwise.streaming import monitor, silence


def test_batches_equal_single_steps(spark):
    rng = random.Random(12)
    rows = []
    for s in range(12):
        t = datetime(2024, 1, 1)
        for _ in range(rng.randrange(1, 60)):
            t += timedelta(minutes=rng.choice([0, 30, 90, 400, 2000]))
            rows.append((f"s{s}", t, rng.choices(["data", "empty", "error", "skipped"], [1, 3 + s % 4, 1, 1])[0]))
    rows.sort(key=lambda r: (r[1], r[2]))
    cuts = [0, 40, 41, 150, 151, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    want, states = [], {}
    for part in parts:
        for s, t, outcome in sorted(part, key=lambda r: (r[0], r[1], r[2])):
            now, kind = monitor.advance(states.get(s, (0, 0, None, [], False)), t.timestamp() / 3600, outcome)
            states[s] = now
            if kind:
                want.append((s, t, kind, now[1]))
    state = spark.createDataFrame([], silence.STATE)
    got = []
    for part in parts:
        changes, state = silence.silence_changes(spark.createDataFrame(part, "source string, at timestamp, outcome string"), state)
        got += [tuple(r) for r in changes.collect()]
        state = spark.createDataFrame([tuple(r) for r in state.collect()], silence.STATE)
    assert sorted(got) == sorted(want) and {k for _, _, k, _ in want} == {"alert", "recovery"}
    ended = {r.source: (r.cycles, r.zeros, r.last, r.gaps, r.alerted) for r in state.collect()}
    for s, (cycles, zeros, last, gaps, alerted) in states.items():
        if cycles:
            assert ended[s][:2] == (cycles, zeros) and ended[s][4] == alerted and [round(g, 2) for g in ended[s][3]] == [round(g, 2) for g in gaps]
            assert (last is None) == (ended[s][2] is None) and (last is None or abs(last - ended[s][2]) < 1e-6)

    folder = new_path(spark, "silence")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "source string, at timestamp, outcome string").coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema("source string, at timestamp, outcome string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    assert sorted(tuple(r) for r in silence.silence_stream(stream, folder).collect()) == sorted(want)
