"""A dictionary as a table against the rule of single keywords, and changes of the register against plain Python."""

import random
import re

from lotwise.functions import dictionary, text
from lotwise.plans import register_changes, registers

ENTRY = "keyword string, rank int, weak boolean, whole boolean, not_before array<string>"


def held(low, keyword, whole, not_before):
    root = keyword if whole else text.stem(keyword)
    m = re.search(rf"(?:^|[^\W\d_])".replace(r"[^\W\d_]", r"[\W\d_]") + re.escape(root), low)
    return bool(m) and not any(low[m.end() : m.end() + 10].startswith(w) for w in not_before or ())


def test_dictionary_equals_single_keywords(spark):
    rng = random.Random(8)
    letters = "abcdef"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)] + ["печать", "печатной", "лента", "3d"]
    texts = [(i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(0, 30))) + rng.choice(["", "-x", " 3d печать", ", лентами"])) for i in range(80)] + [(100, None), (101, "")]
    entries = [(w, k, k % 7 == 0, k % 5 == 0, [words[k][:1]] if k % 11 == 0 else None) for k, w in enumerate(rng.sample(sorted(set(words)), 150))]
    entries += [("3d печать", 1000, False, False, None), ("abc def", 1001, False, True, None), ("ab+", 1002, False, True, None), (None, 1, False, False, None), ("", 2, False, False, None)]
    got = {}
    for r in dictionary.keyword_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(entries, ENTRY), ("лент",)).collect():
        got.setdefault(r.id, set()).add(r.keyword)
    want = {}
    for i, t in texts:
        low = (t or "").lower()
        for k, _, weak, whole, not_before in entries:
            if k and held(low, k, whole, not_before) and not (weak and "лент" in low):
                want.setdefault(i, set()).add(k)
    assert got == want


def test_large_dictionary(spark):
    texts = spark.range(300).selectExpr("id", "concat('слово', id * 31, ' qwerty', char(97 + id % 26), 'zz tail') as text")
    entries = [(f"qwerty{chr(97 + k % 26)}{'z' * (k // 26 % 3)}", k, False, True, None) for k in range(78)] + [(f"none{k}x", 100 + k, False, True, None) for k in range(10_000)]
    got = {r.id: r.keyword for r in dictionary.first_keywords(texts, spark.createDataFrame(entries, ENTRY)).collect()}
    assert got == {i: f"qwerty{chr(97 + i % 26)}" for i in range(300)}


def test_stem_is_that_of_the_list(spark):
    words = ["печать", "лента", "карточка", "дом", "а", "лентаия", "abcdка", "продукция"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(dictionary.stem_of(df.w).alias("s")).collect()] == [text.stem(w) for w in words]


def test_merges_equal_one_after_the_other(spark):
    rng = random.Random(9)
    number = lambda k: str(100_000_000 + k)
    entities = [(f"c-{number(k)}", f"n{k}", rng.randrange(500) if k % 5 else None, k, k % 4 == 0, f"by{k}" if k % 4 == 0 else None, None) for k in range(0, 60, 2)]
    members = [(f"c-{number(k)}", 1, number(k)) for k in range(0, 60, 2)] + [("c-100000000", 2, number(1))]
    decisions = [(d, [number(rng.randrange(60)) for _ in range(rng.randrange(1, 4))] + ["x"], f"m{d}", "who", f"2024-01-{1 + d % 9:02}") for d in range(14)]
    parts = {e[0]: {"id": e[0], "name": e[1], "rank": e[2], "pinned": e[4], "inns": {m[2] for m in members if m[0] == e[0]}} for e in entities}
    for d, inns, name, by, day in sorted(decisions, key=lambda x: (x[4], x[0])):
        inns = list(dict.fromkeys(i for i in inns if i != "x"))
        if len(inns) > 1:
            own = [p for p in parts.values() if p["inns"] & set(inns)]
            for p in own:
                del parts[p["id"]]
            new = {"id": f"new{d}", "name": name, "rank": min((p["rank"] for p in own if p["rank"] is not None), default=None), "pinned": any(p["pinned"] for p in own), "inns": set(inns).union(*[p["inns"] for p in own])}
            parts[new["id"]] = new
    e, m = register_changes.merged(
        spark.createDataFrame(entities, "id string, name string, rank int, score int, pinned boolean, pinned_by string, merged_by string"),
        spark.createDataFrame(members, "id string, place int, inn string"), spark.createDataFrame(decisions, "decision long, inns array<string>, name string, by string, day string"),
    )
    sets = {}
    for r in m.collect():
        sets.setdefault(r.id, set()).add(r.inn)
    got = {frozenset(sets[r.id]): (r.name, r.rank, r.pinned) for r in e.collect()}
    assert got == {frozenset(p["inns"]): (p["name"], p["rank"], p["pinned"]) for p in parts.values()} and e.count() == len(parts)


def test_rejected_proposals_are_not_made_again(spark):
    old = spark.createDataFrame([(["1", "2"], "rejected"), (["3", "4"], "proposed"), (["5", "6"], "proposed"), (["7", "8"], "proposed")], "inns array<string>, status string")
    new = spark.createDataFrame([(["2", "1"],), (["9", "8"],), (["8", "9"],)], "inns array<string>")
    members = spark.createDataFrame([("3", "a"), ("4", "a"), ("5", "b"), ("6", "c")], "inn string, id string")
    gone = spark.createDataFrame([(["8", "7"],), (["4", "3"],)], "inns array<string>")
    out = register_changes.settled_proposals(register_changes.proposed(old, new), members, gone)
    assert sorted((sorted(r.inns), r.status) for r in out.collect()) == [(["1", "2"], "rejected"), (["3", "4"], "confirmed"), (["5", "6"], "proposed"), (["7", "8"], "rejected"), (["8", "9"], "proposed")]


def test_links_once(spark):
    old = spark.createDataFrame([("a", "7", "x")], "id string, company string, name string")
    new = spark.createDataFrame([("7", "x2", "1"), ("8", "y", "1"), ("8", "y", "2"), ("9", "z", "77")], "company string, name string, inn string")
    members = spark.createDataFrame([("1", "a"), ("2", "a")], "inn string, id string")
    assert sorted(map(tuple, register_changes.links(old, new, members).collect())) == [("a", "7", "x"), ("a", "8", "y")]


def test_pinned_buyers_far_down_keep_their_rank(spark):
    ranked = spark.createDataFrame([(k, f"n{k}", k, 1000 - k) for k in range(1, 400)], "inn int, name string, rank int, score int")
    previous = spark.createDataFrame([(333, "old", True, "note"), (5, "old5", False, "n5"), (900, "gone", True, None), (350, "x", False, None)], "inn int, name string, pinned boolean, note string")
    got = {r.inn: (r.name, r.rank, r.score, r.note) for r in registers.rebuilt(ranked, previous, 10).collect()}
    assert set(got) == {*range(1, 11), 333, 900} and got[333] == ("n333", 333, 667, "note") and got[900] == ("gone", None, 0, None) and got[5][3] == "n5"


def test_replay_by_rules_of_the_time(spark):
    from datetime import datetime as t

    versions = [("a", t(2024, 1, 1), t(2024, 2, 1), 100.0, None), ("a", t(2024, 2, 1), None, 10.0, None), ("b", t(2024, 1, 15), None, None, "Bad"), ("other", t(2024, 1, 1), None, 1e9, None)]
    lots = [(1, t(2024, 1, 10), 50.0, "ok"), (2, t(2024, 2, 1), 50.0, "ok"), (3, t(2024, 1, 10), 500.0, "so bad"), (4, t(2024, 3, 5), 500.0, "so bad"), (5, t(2024, 3, 5), None, "bad"), (6, t(2023, 5, 5), 0.0, "bad")]
    out = register_changes.replayed(spark.createDataFrame(lots, "id int, at timestamp, price double, text string"), spark.createDataFrame(versions, "stage string, since timestamp, until timestamp, least double, word string"), ["a", "b"])
    assert {r.id: r.stage for r in out.collect()} == {1: "a", 2: None, 3: None, 4: "b", 5: "a", 6: None}


def test_words_that_begin_with_a_root_are_not_searched_again(spark):
    """A text is joined and searched only for keywords with more conditions than one word's beginning."""
    texts = spark.createDataFrame([(1, "Ab abcde abcdef, xyabc"), (2, None), (3, "nothing")], "id long, text string")
    entry = spark.createDataFrame([("abcde", 1, False, True, None), ("xyab", 2, False, True, None), ("bcd", 3, False, True, None), ("ab", 4, False, True, ["c"])], "keyword string, rank int, weak boolean, whole boolean, not_before array<string>")
    assert sorted(tuple(r) for r in dictionary.keyword_hits(texts, entry.limit(3)).collect()) == [(1, "abcde", 1), (1, "xyab", 2)]
    sure = dictionary.keyword_hits(texts, entry.filter("not_before is null"))
    assert sorted(tuple(r) for r in sure.collect()) == [(1, "abcde", 1), (1, "xyab", 2)]
