"""Cursor chains, keyset reads and backfills against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from lotwise.functions import graphs
from lotwise.session import new_path
from lotwise.sources import paging


def test_cursors_in_order_loops_and_gaps(spark):
    rng = random.Random(5)
    rows, want, ends = [], {}, {}
    for feed, (n, tail) in enumerate([(1, None), (37, None), (37, 5), (20, 999), (3, 0)]):
        order = rng.sample(range(100), n)
        for place, (c, after) in enumerate(zip(order, [*order[1:], None if tail is None else 999 if tail == 999 else order[tail]], strict=True)):
            rows.append((feed, c, after))
            want[feed, c] = place
        rows.append((feed, 500, order[0]))  # leads into the chain, but nothing leads to it
        ends[feed] = "archive_end" if tail is None else "missing_page" if tail == 999 else "loop"
    pages = spark.createDataFrame(rows + rows[:3], "feed int, cursor int, next int")
    starts = spark.createDataFrame([(f, next(c for (g, c), p in want.items() if g == f and p == 0)) for f in range(5)], "feed int, cursor int")
    placed = paging.cursor_pages(pages, starts)
    assert {(r.feed, r.cursor): r.place for r in placed.collect()} == want
    assert {r.feed: r.completion for r in paging.cursor_completion(pages, placed).collect()} == ends
    assert paging.cursor_pages(pages, starts.limit(0)).count() == 0


def test_groups_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200 + k, 201 + k) for k in range(60)] + [(300, 300), (None, 1), (2, None)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = graphs.groups(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.node: r.least for r in got} == {n: top(n) for n in root} and len(got) == len(root)


def test_keyset_reads_leave_files_out(spark):
    rows = [(i, (i * 7) % 100, f"v{i}") for i in range(1000)] + [(-1, None, "no key")]
    folder = new_path(spark, "keyed")
    paging.save_by_key(spark.createDataFrame(rows, "id long, at long, v string"), "at", folder, 10)
    saved = paging.keyed_pages(spark, folder, "at", "id long, at long, v string")
    assert sorted(tuple(r) for r in saved.collect()) == sorted(r for r in rows if r[1] is not None)
    after = saved.filter(paging.after_key("at", "id", F.lit(90).cast("long"), F.lit(500).cast("long")))
    assert sorted((r.at, r.id) for r in after.collect()) == sorted((at, i) for i, at, _ in rows if at is not None and (at, i) > (90, 500))
    assert after.rdd.getNumPartitions() < saved.rdd.getNumPartitions() and after.rdd.getNumPartitions() <= 2
    assert saved.filter("at > 5000").count() == 0 and saved.filter("at = 14 and v = 'v2'").count() == 1


def test_backfills_in_any_order(spark):
    day = datetime.date(2024, 1, 1)
    at = lambda n: day + datetime.timedelta(days=n)
    rng = random.Random(7)
    spans = [("a", at(s), at(s + rng.randrange(-1, 6))) for s in (rng.randrange(90) for _ in range(25))] + [("b", at(-5), at(200)), ("c", None, at(3))]
    held = {f: {d for g, s, e in spans if g == f and s for d in (s + datetime.timedelta(days=k) for k in range((e - s).days + 1))} for f in "abc"}
    df = spark.createDataFrame(spans, "feed string, first date, last date")
    merged = paging.merged_spans(df).collect()
    days = lambda rows: {(r.feed, r.first + datetime.timedelta(days=k)) for r in rows for k in range((r.last - r.first).days + 1)}
    assert days(merged) == {(f, d) for f in held for d in held[f]}
    wanted = spark.createDataFrame([(f, at(0), at(99)) for f in "abcd"], "feed string, first date, last date")
    rest = paging.missing_spans(df, wanted)
    assert days(rest.collect()) == {(f, at(k)) for f in "abcd" for k in range(100) if at(k) not in held.get(f, ())}
    assert paging.missing_spans(df.union(rest), wanted).count() == 0  # the union of all runs is one run
    shuffled = paging.merged_spans(df.union(rest).orderBy(F.rand(3)))
    assert days(shuffled.collect()) >= {(f, at(k)) for f in "abcd" for k in range(100)}


def test_what_pages_prove(spark):
    d = datetime.date
    rows = [("a", 0, d(2024, 1, 8), d(2024, 1, 10), 5), ("a", 1, d(2024, 1, 5), d(2024, 1, 8), 5), ("a", 3, d(2024, 1, 1), d(2024, 1, 2), 5), ("b", 0, d(2024, 1, 2), d(2024, 1, 9), 5), ("b", 1, None, None, 0), ("c", 1, d(2024, 1, 1), d(2024, 1, 2), 1), ("d", 0, d(2023, 12, 30), d(2024, 1, 4), 9)]
    got = {r.feed: (r.first, r.last) for r in paging.page_span(spark.createDataFrame(rows, "feed string, place int, oldest date, newest date, rows int"), F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"a": (d(2024, 1, 6), d(2024, 1, 10)), "b": (d(2024, 1, 1), d(2024, 1, 9)), "d": (d(2024, 1, 1), d(2024, 1, 4))}


def test_places_and_completion_are_never_broadcast(spark):
    """Joins of tables of all pages sort, however small the tables are: what is broadcast goes through the driver."""
    pages = spark.createDataFrame([(0, i, i + 1 if i < 20 else None) for i in range(21)], "feed long, cursor long, next long")
    placed = paging.cursor_pages(pages, spark.createDataFrame([(0, 0)], "feed long, cursor long"))
    assert sorted((r.cursor, r.place) for r in placed.collect()) == [(i, i) for i in range(21)]
    ends = paging.cursor_completion(pages, placed)
    assert ends.first().completion == "archive_end" and "Broadcast" not in ends._jdf.queryExecution().executedPlan().toString()
