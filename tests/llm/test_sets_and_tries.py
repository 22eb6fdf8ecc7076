"""op11 to op13 over nulls, ties, repeats, long texts, clashing names and empty tables, against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_edges import LONG, SCHEMA, rows, words

from lotwise.llm import audit, components, jaccard, neardup, shared, trie

WORDS = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(turns):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = {}
    for r in sorted((r for r in turns if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + seq[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = set()
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.add((min(convs), len(prefix), parent, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(df):
    got = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_equals_plain_python(spark):
    rng = random.Random(11)
    turns = []
    for c in [*range(0, 130), 400, -7, -20]:
        line = [("user", f"start {c % 3}"), ("assistant", "same reply here"), ("user", f"q {c % 7}"), ("assistant", "x " * rng.randrange(4)), ("user", f"own {c}")][: rng.randrange(1, 6)]
        turns += [(c, t * 10, role, text) for t, (role, text) in enumerate(line)]
    turns += [(c, t, "user", f"deep {t}") for c in (500, 520, 540, 561) for t in range(12)] + [(561, 12, "user", "one more")]  # equal ones and a longer one
    turns += [(700, None, "system", "null turn first"), (700, 1, None, None), (700, 1, "", "tie"), (700, 1, "user", "tie"), (700, 1, "user", "tie"), (None, 1, "user", "nobody's"), (720, 3, "user", LONG), (900, 0, "user", "")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    assert nodes(trie.prefix_trie(df)) == brute_trie(turns)
    clashing = df
    for name in ("rep", "node", "depth", "key", "words", "at", "part", "parent", "weight"):
        clashing = clashing.withColumn(name, F.lit("own"))
    few = [t for t in turns if t[0] is not None and t[0] < 20]
    assert nodes(trie.prefix_trie(clashing.filter("conv_id < 20"))) == brute_trie(few)


def test_one_long_conversation_is_dealt_among_tasks(spark):
    turns = [(0, t, "user", f"turn {t % 50} of it") for t in range(3000)] + [(1, t, "user", f"turn {t}") for t in range(5)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        numbered = trie.ordered_turns(spark.createDataFrame(turns, TURNS))
        got = [(r.at, r.upto) for r in numbered.filter("conv_id = 0").orderBy("at").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [(k, 4 * k) for k in range(1, 3001)]


def test_trie_of_little(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    none = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its first turn is its group's, which has none
    for turns in ([(none, 1, "user", "gone")], [(0, 1, "user", "a b")], [(0, 1, "user", "a b"), (20, 1, "user", "a b"), (None, 1, "x", "y")]):
        assert nodes(trie.prefix_trie(spark.createDataFrame(turns, TURNS))) == brute_trie(turns)


def test_trie_broadcasts_no_conversations(spark):
    turns = spark.createDataFrame([(c, t, "user", f"{c % 3} {t}") for c in range(40) for t in range(5)], TURNS)
    rebuilt, convs = trie.rebuilt_turns(trie.ordered_turns(turns).localCheckpoint())
    _, members = trie._classes(rebuilt, convs)
    for df in (rebuilt, members):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


def test_near_duplicates_broadcast_no_classes(spark):
    table = lambda rows_, schema: shared.materialise(spark.createDataFrame(rows_, schema), "test")  # noqa: E731  files, so that Spark knows they are small
    signed = table([(1, 3, b"x"), (2, 3, b"y"), (3, 3, b"y"), (4, 0, None)], "doc_id long, n_shingles long, digest binary")
    classes = table([(b"x", 10, 1), (b"y", 20, 2)], "digest binary, cid long, rep long")
    out = neardup.labelled_rows(signed, classes, table([(20, 10)], "a long, b long"))
    assert out._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2  # one by component, one by digest
    assert sorted(map(tuple, out.collect())) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True)]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    flags = []
    for i, text, lang, *_ in docs:
        x = text or ""
        w = WORDS.findall(x)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x),
            "D": any(c in "#$%&*|" for c in x), "E": i is not None and first.get(x, i) < i,
        }
        flags.append((lang or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        credit = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, k in enumerate(order, 1):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                credit[k] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == {k} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                if sum(k in f[1] for f in own) < len(gone):
                    raise AssertionError
        for (p, order, step), v in out.items():
            if p == part:
                v.append(credit[order[step - 1]])
    # A filter's redundant documents failed it but went at an earlier step.
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_plain_python(spark):
    docs = rows() + [(300, "SHOUT " * 250, "fr", "x", 1), (301, "SHOUT " * 250, None, "x", 1), (302, "a|b " * 300, "", "x", 1), (303, " ".join(f"w{k}" for k in range(300)), "en", "x", 1), (304, "\x0b\x0c x\x0by", "en", "x", 1)]
    labels = [(300, 1, 0), (300, 0, 1), (303, 1, None), (20, None, 1), (75, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("part", "bits", "step", "first", "h1", "good", "toxic", "filter_order", "failed"):
        df = df.withColumn(name, F.lit("own"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in audit.filter_audit(df, lab).collect()}
    assert got == brute_audit(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})
    assert audit.filter_audit(df.limit(0), lab).count() == 0
    bare = audit.filter_audit(df.filter("doc_id = 303"), lab.limit(0)).collect()
    assert len(bare) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in bare)


def test_audit_broadcasts_nothing_that_grows(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1), (2, "a b", "en", "x", 1), (3, "c", None, "x", 1)], SCHEMA)
    flagged = audit.flags(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    plan = lambda: flagged._jdf.queryExecution().executedPlan().toString()
    assert plan().count("SortMergeJoin") == 2 and "Broadcast" not in plan()
    assert sorted(map(tuple, flagged.collect())) == [("", 1, 0, 0), ("en", 1, 1, 0), ("en", 17, 0, 1)]
    assert "Broadcast" not in plan()  # nor once the sizes are known


def brute_jaccard(data, percent):
    sets, size = {}, []
    for i, text, *_ in data:
        w = words(text)
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        size.append((i, len(s)))
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(s))
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and top(a) != top(b) and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), n, str(None if i is None else top(i))) for i, n in size)


@pytest.mark.parametrize("percent", [80, 60])
def test_jaccard_equals_plain_python(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"v{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    data = rows()
    base = [rng.choice(vocabulary) for _ in range(80)]
    for i in range(1000, 1090):  # near copies of one text at all distances, many of them not linked with it
        near = list(base)
        for _ in range(rng.randrange(0, 7)):
            near[rng.randrange(80)] = rng.choice(["edit", f"e{i}", f"s{i % 5}"])
        data.append((i, " ".join(near), "en", "x", 1))
    for i in range(2000, 2060):  # a passage that takes a third to nine tenths of the text
        own = [f"o{i}_{k}" for k in range(rng.choice([6, 8, 12, 14, 16, 40, 110]))]
        data.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]), "en", "x", 1))
    for i in range(3000, 3040):  # a chain: each is linked with the next one only
        data.append((i, " ".join(f"c{k}" for k in range((i - 3000) * 4, (i - 3000) * 4 + 50)), "en", "x", 1))
    for i in range(4000, 4030):
        data.append((i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))), "en", "x", 1))
    data += [(20, "another text of document twenty with more words", "en", "x", 1), (5000, "another text of document twenty with more words", "en", "x", 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    for name in ("cid", "token", "home", "comp", "digest", "rep", "n"):
        df = df.withColumn(name, F.lit("own"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df, percent=percent).collect())
    assert got == brute_jaccard(data, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    little = spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0), (None, "a b", "", "", 0)], SCHEMA)
    assert sorted(map(str, jaccard.jaccard_components(little).collect())) == sorted(["Row(doc_id=1, n_shingles=0, component_id=1)", "Row(doc_id=2, n_shingles=0, component_id=2)", "Row(doc_id=None, n_shingles=1, component_id=None)"])


def test_components_are_settled_before_pairs(spark, monkeypatch):
    """What links found so far connect must not meet as sets of different components, however the links were dealt."""
    texts = [(i, " ".join(f"c{k}" for k in range(i * 4, i * 4 + 50)), "en", "x", 1) for i in range(60)]
    found, apart, ask, make = [], [], jaccard._home_pairs, jaccard._open_pairs

    def home_pairs(*given):
        found.append(ask(*given))
        return found[0]

    def open_pairs(index, *more):
        comp = index.select("cid", "comp").distinct()
        ends = found[0][1].join(comp.toDF("a", "x"), "a").join(comp.toDF("b", "y"), "b")
        apart.append((ends.filter("x <> y").count(), ends.count() > 0))
        return make(index, *more)

    monkeypatch.setattr(jaccard, "_home_pairs", home_pairs)
    monkeypatch.setattr(jaccard, "_open_pairs", open_pairs)
    none = lambda links: links.filter("false").select(F.col("a").alias("node"), F.col("b").alias("least"))
    monkeypatch.setattr(jaccard, "drawn_together", lambda links: (links, none(links)))  # a round that drew nothing together
    got = jaccard.jaccard_components(spark.createDataFrame(texts, SCHEMA).repartition(4))
    assert [r.component_id for r in got.select("component_id").distinct().collect()] == [0]
    assert apart == [(0, True)]


def test_shared_tokens_are_told_once(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 6)
    rng = random.Random(2)
    rows = sorted((t, rng.randrange(-40, 40)) for t in (0, 0, 1, 2, 3, -5, *[7] * 60, *[8] * 9, 9, *[10] * 5, *[11] * 90) for _ in range(2))
    having = {t: {c for u, c in rows if u == t} for t, _ in rows}
    expected = [(t, c, min(len(having[t]), 6)) for t, c in sorted(set(rows)) if len(having[t]) > 1]
    for size in (1, 2, 3, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[lo : lo + size]], pa.int64()) for k in (0, 1)], names=["token", "cid"]) for lo in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in jaccard._shared_tokens(iter(batches)) for r in b.to_pylist()] == expected
    assert list(jaccard._shared_tokens(iter([]))) == []


def test_masks_refute_no_link(spark):
    rnd = random.Random(7)
    sets = [{rnd.randrange(1 << 64) for _ in range(n)} for n in (1, 7, 150, 900)]
    sets += [{t for t in s if rnd.random() < 0.9} | {rnd.randrange(1 << 64) for _ in range(len(s) // 12)} for s in sets]
    rows = [(k, len(s), *jaccard.mask(np.array(sorted(s), np.uint64)).tolist()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "k int, n long, " + ", ".join(f"{c} long" for c in jaccard.MASK))
    both = df.select(*[F.col(c).alias(f"x_{c}") for c in df.columns]).crossJoin(df.select(*[F.col(c).alias(f"y_{c}") for c in df.columns]))
    got = {(r.x_k, r.y_k) for r in both.filter(jaccard.not_refuted("x_", "y_", 80)).collect()}
    linked = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)}
    assert linked <= got and (2, 3) not in got and len(got) < len(sets) ** 2


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_settle_in_few_rounds(spark, monkeypatch, kind):
    rng, written = random.Random(11), []
    write = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or write(df, name))
    name = rng.sample(range(1000, 2000), 400)
    edges = [(name[k], name[k + 1]) for k in range(299)]  # a chain of 300 and a hub of 100, in any order
    edges += [(name[300], name[k]) for k in range(301, 400)] + [(5, 5), (None, 6)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(3)
    least = {str(i): str(min(part)) for part in (name[:300], name[300:]) for i in part}
    assert {str(r.node): str(r.component) for r in components.connected_components(df).collect()} == least
    assert len(written) <= 3, written
    monkeypatch.setattr(components, "AT_ONCE", 10)
    assert {str(r.node): str(r.component) for r in components.connected_components(df).collect()} == least
    edges, leasts = components.drawn_together(df)
    assert {str(r.node): str(r.component) for r in components.connected_components(edges).collect()} == least
    assert all(least[str(r.node)] == least[str(r.least)] for r in leasts.collect())
