"""Alerted twins go, but lots listed again with a later deadline stay."""

import random
from datetime import datetime, timedelta

from lotwise.plans import matching


def test_reposts_stay(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    # (id, key, created_at, deadline): any of them may be unknown
    row = lambda i: (i, rng.choice(["a", "b", "c", None]), rng.choice([None] + [start + timedelta(days=rng.randrange(90), seconds=rng.choice([0, 1]))] * 9), rng.choice([None, "soon"] + [f"2024-0{rng.randrange(1, 7)}-11", f"до 12.0{rng.randrange(1, 7)}.2024"] * 8))
    asked = [row(i) for i in range(60)] + [(90, "x", start, "2024-03-01"), (91, "x", start + timedelta(days=14), "2024-02-01"), (92, "x", start + timedelta(days=15), "нет")]
    sent = [row(100 + i) for i in range(14)] + [(190, "x", start, "2024-02-01")] * 2

    def day(d):
        return None if not d or not any(c.isdigit() for c in d) else d if d[4] == "-" else f"{d[-4:]}-{d[-7:-5]}-{d[-10:-8]}"

    want = set()
    for i, k, at, deadline in asked:
        near = [day(s[3]) for s in sent if s[1] == k and at and s[2] and abs(s[2] - at) <= timedelta(days=14)]
        prev = None if None in near else max(near, default=None)
        if not near or (prev and day(deadline) and day(deadline) > prev):
            want.add((i, prev))
    frame = lambda rows: spark.createDataFrame(rows, "id long, key string, created_at timestamp, deadline string")
    got = matching.twins_or_reposts(frame(asked), frame(sent), ["key"], "created_at", "deadline", 14).collect()
    assert {(90, "2024-02-01"), (92, None)} <= want and not any(i == 91 for i, _ in want)
    assert len(got) == len(want) and {(r.id, r.prev_deadline) for r in got} == want
