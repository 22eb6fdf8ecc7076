"""Breadth-first crawls, as-of joins of repeated rows, medians and retries against plain Python."""

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lotwise.plans import matching, pages, registry, trends
from lotwise.streaming import late


def test_frontier_equals_breadth_first_search(spark):
    rng = random.Random(2)
    links = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    df = spark.createDataFrame(sorted(links), "a long, b long")
    for most in (1, 8, 25, 1000):
        depth, level = {0: 0}, [0]
        while level and len(depth) < most:
            level = sorted({b for a, b in links if a in level} - set(depth))[: most - len(depth)]
            depth |= {n: max(depth.values()) + 1 for n in level}
        got = pages.crawl_frontier(df, spark.createDataFrame([(0,)], "node long"), most).collect()
        assert {r.node: r.depth for r in got} == depth and len(got) == len(depth)


def test_nearest_keeps_rows_that_repeat(spark):
    day = datetime(2024, 1, 10)
    left = spark.createDataFrame([("a", day), ("a", day), ("b", day)], "k string, at timestamp")
    right = spark.createDataFrame([("a", day + timedelta(days=d), d) for d in (-3, 2, 5)], "k string, time timestamp, v int")
    got = trends.nearest(left, right, "k", "at", "time", "v", 4).collect()
    assert sorted((r.k, r.nearest) for r in got if r.k == "a") == [("a", 2), ("a", 2)] and len(got) == 3


def test_medians_of_any_values(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 200):
        values = [rng.choice([rng.uniform(-5, 5), rng.uniform(-1e6, 1e6), 3.0, 0.0]) for _ in range(n)]
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = [r.v for r in registry.median_filled(rows, "v").collect()]
        assert abs(sum(got) - sum(values) - statistics.median(values)) < 1e-6


def test_twins_of_one_key_meet_within_their_days(spark):
    begin = datetime(2024, 1, 1)
    at = lambda d: begin + timedelta(days=d)
    candidates = [(i, None if i % 3 else "x", at(7 * i)) for i in range(40)] + [(99, "x", None)]
    sent = [(None, at(0)), (None, at(100)), ("x", at(60)), ("x", None)]
    c, s = spark.createDataFrame(candidates, "id long, org string, at timestamp"), spark.createDataFrame(sent, "org string, at timestamp")
    want = sorted(i for i, org, t in candidates if not any(o == org and t and u and abs(t - u) <= timedelta(days=14) for o, u in sent))
    assert sorted(r.id for r in matching.twins_within(c, s, ["org"], "at", 14).collect()) == want


def test_retries_wait_for_their_turn(spark):
    window = spark.createDataFrame([(i, i) for i in range(5)], "id long, at long")
    undecided = spark.createDataFrame([(i, -i) for i in range(3, 30)], "id long, at long")
    got = late.with_retries(window, undecided, "id", "at", most=10).collect()
    assert sorted(r.id for r in got if r.retry) == list(range(20, 30)) and len(got) == 15
    left = late.with_retries(window, undecided.filter(F.col("id") < 20), "id", "at", most=10).collect()
    assert sorted(r.id for r in left if r.retry) == list(range(10, 20))


def test_late_items_are_fresh(spark):
    items = spark.createDataFrame([(i,) for i in (5, 101, 102, 103, 104)], "id long")
    seen, fails = spark.createDataFrame([(102,), (104,)], "id long"), spark.createDataFrame([(103, 6), (101, 5)], "id long, fails int")
    assert [r.id for r in late.fresh_items(items, seen, fails, 100).collect()] == [101]
    assert sorted(r.id for r in late.advanced_seen(seen, items, kept=3).collect()) == [102, 103, 104]
