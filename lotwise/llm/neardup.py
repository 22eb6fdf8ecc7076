"""MinHash near-duplicate detection with tensored banding.

Two small collections of t half keys (each of h minhashes) are computed; the t * t tables are keyed by the pairs
(left half i, right half j). So 2 * t * h minhash functions do the work of t * t * 2 * h: about the square root.
At Jaccard similarity s a pair meets in some table with probability (1 - (1 - s^h)^t)^2.

Steps, all of them DataFrame stages:

1. `signatures`: one pass over the texts gives the set size, a digest of the whole shingle set, the 2 * t halves, and a
   sketch: two bits of each minhash.
2. Rows with equal digests are one class (aggregated before the shuffle, so thousands of copies cost one row a task). A class
   goes by its digest, never by a doc_id, which may repeat; its number `cid` is a hash of the digest by a seed under which no
   two classes clash.
3. Halves that no other class has are dropped; the rest are paired into table keys. A table's members are compared with its
   least member by their sketches: those that agree are linked. A table of which not all members agree with the least is
   looked into: in a task of its own (dealt into parts, if it is large) all its sketches are compared, and a spanning forest
   of those that agree comes out. So a pair that meets in a table and whose sketches agree is in one *family*, and
   pairs of low similarity, of which a table also holds some, join no families. The sketches of a pair at 0.75 agree but for
   about 3 in a million.
4. `verify`: full shingle sets are intersected through an inverted index. A family is dealt into parts of even size; each
   part meets in a task together with the family's hub. What is not linked with the hub by then meets every part in a second
   round, so no link between different texts is lost, memory is bounded, and a group of copies costs one task a part.
5. Connected components of the confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, key_filter, marked_by_filter, materialise, spread_join
from .words import U64, Words, grams, mix, slices, stream

#: A part of a family holds about so many texts, and so many shingles in all; a part of a table holds so many sketches.
PART_TEXTS, PART_SHINGLES, PART_SKETCHES = 256, 1_000_000, 2048
#: Minhashes whose two bits fit into one long of a sketch.
FIELDS = 30
SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, left array<long>, right array<long>, sketch array<long>"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a text of fewer words is one shingle, one without words none."""
    words = Words(buf, offsets)
    runs, bounds = grams(words.hash, k), words.bounds
    out = []
    for i in range(len(offsets) - 1):
        n = bounds[i + 1] - bounds[i]
        if n >= k:
            out.append(np.unique(runs[bounds[i] : bounds[i + 1] - k + 1]))
        elif n:
            out.append(grams(words.hash[bounds[i] : bounds[i + 1]], int(n), seed=100 + int(n)))
        else:
            out.append(np.empty(0, U64))
    return out


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):  # a block of the table of values stays in the cache
        v = x[lo : lo + 512, None] * a
        v += b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(0), out=least)
    return least


def _sign(batches: Iterator[pa.RecordBatch], k: int, h: int, t: int) -> Iterator[pa.RecordBatch]:
    a, b = (stream(2 * t * h, s).astype(np.uint32) | np.uint32(1) for s in (11, 12))
    weight, salt = stream(h, 13) | U64(1), stream(2 * t, 14)
    longs = sketch_longs(h, t)
    shift = U64(2) * np.arange(FIELDS, dtype=U64)
    lists = lambda flat, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))
    for batch in batches:
        sizes, digests, halves, sketches = [], [], [], []
        for _, _, buf, offsets in slices(batch.column(2)):
            for s in shingle_sets(buf, offsets, k):
                sizes.append(len(s))
                digests.append(digest(s))
                bits = np.zeros(longs * FIELDS, U64)
                if len(s):
                    part = _minhash(s, a, b).astype(U64)
                    bits[: len(part)] = part & U64(3)
                    halves.append(mix((part.reshape(2 * t, h) * weight).sum(1, dtype=U64) ^ salt))
                else:
                    halves.append(salt)
                sketches.append((bits.reshape(longs, FIELDS) << shift).sum(1, dtype=U64))
        flat = np.array(halves, U64).reshape(-1, 2 * t).view(np.int64)
        columns = [
            batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            lists(flat[:, :t].ravel(), t), lists(flat[:, t:].ravel(), t), lists(np.array(sketches, U64).reshape(-1).view(np.int64), longs),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", "left", "right", "sketch"])


def sketch_longs(h: int, t: int) -> int:
    return -(-2 * t * h // FIELDS)


def signatures(docs: DataFrame, words: int = 5, h: int = 3, t: int = 15) -> DataFrame:
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(partial(_sign, k=words, h=h, t=t), SIGNED)


def differing(h: int, t: int, least: float = 0.5) -> int:
    """How many of the 2 * t * h fields of two sketches may differ: unlike minhashes agree in one field of four."""
    return int(2 * t * h * 0.75 * (1 - least))


def classes_of(signed: DataFrame, *carried: str) -> tuple[DataFrame, int]:
    """One row for each distinct shingle set: its digest and cid, its row of the least (doc_id, text_hash), and the columns `carried`.

    Also the seed under which no two classes have the same cid.
    """
    rows = signed.filter("digest is not null and doc_id is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", *carried)]
    grouped = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", F.struct("doc_id", "text_hash")).alias("rep_hash"), *first), "classes")
    seed = 0
    while not grouped.groupBy(F.xxhash64("digest", F.lit(seed))).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        seed += 1
    return grouped.withColumn("cid", F.xxhash64("digest", F.lit(seed))), seed


def _tables(classes: DataFrame) -> DataFrame:
    """(key, cid, sketch): the members of every table, without the halves that no other class has."""
    halves = classes.select("cid", "sketch", F.lit(True).alias("is_left"), F.explode("left").alias("half")).union(
        classes.select("cid", "sketch", F.lit(False), F.explode("right"))
    )
    met = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    side = lambda left: F.collect_set(F.when(F.col("is_left") == left, F.col("half")))
    shared = spread_join(halves.drop("sketch"), met, ["half"], ["cid"]).groupBy("cid").agg(side(True).alias("left"), side(False).alias("right"))
    shared = shared.filter("size(left) > 0 and size(right) > 0").join(classes.select("cid", "sketch"), "cid")
    return (
        shared.select("cid", "sketch", "right", F.explode("left").alias("l"))
        .select("cid", "sketch", "l", F.explode("right").alias("r"))
        .select(F.xxhash64("l", "r").alias("key"), "cid", "sketch")
    )


def _agreeing(ours: np.ndarray, theirs: np.ndarray, most: int) -> np.ndarray:
    """Which rows of sketches differ from one sketch in at most `most` fields."""
    x = ours ^ theirs
    x = (x | (x >> U64(1))) & U64(0x5555555555555555)
    return np.bitwise_count(x).sum(1) <= most


def _forest(table: pa.Table, most: int) -> pa.Table:
    """The trees of the members whose sketches agree: each member with the least of its tree, so that tables of one group give the same edges."""
    table = table.combine_chunks()
    cid = table.column("cid").to_numpy()
    flat = table.column("sketch").combine_chunks().flatten().to_numpy().view(U64)
    sketch = flat.reshape(len(cid), -1) if len(cid) else flat.reshape(0, 1)
    tree = np.arange(len(cid))
    for i in range(len(cid)):
        other = np.flatnonzero(tree != tree[i])
        if not len(other):
            break
        near = other[_agreeing(sketch[other], sketch[i], most)]
        for t in np.unique(tree[near]):
            tree[tree == t] = tree[i]
    least = np.full(len(cid), np.iinfo(np.int64).max)
    np.minimum.at(least, tree, cid)
    own = cid != least[tree] if len(cid) else np.empty(0, bool)
    return pa.table({"a": pa.array(cid[own], pa.int64()), "b": pa.array(least[tree][own] if len(cid) else cid, pa.int64())})


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each node keeps its least lesser neighbour, and its other ones go on with that one."""
    least = F.min("b").over(Window.partitionBy("a"))
    told = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().withColumn("least", least), "told")
    return told.select("a", F.col("least").alias("b")).union(told.filter("b <> least").select("b", "least")).distinct()


def _families(classes: DataFrame, h: int, t: int) -> DataFrame:
    """(cid, family) of the classes that are linked by sketches that agree with those of others of their tables."""
    most = differing(h, t)
    tables = materialise(_tables(classes), "tables")
    heads = tables.groupBy("key").agg(F.min(F.struct("cid", "sketch")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / PART_SKETCHES).cast("int").alias("parts")
    heads = heads.select("key", F.col("head.cid").alias("head"), F.col("head.sketch").alias("head_sketch"), parts)
    differ = F.lit(0)
    for i in range(sketch_longs(h, t)):
        x = F.get("sketch", F.lit(i)).bitwiseXOR(F.get("head_sketch", F.lit(i)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    asked = spread_join(tables, heads, ["key"], ["cid"]).filter("cid <> head").select("key", "cid", "head", "parts", (differ <= most).alias("agrees"))
    asked = materialise(asked, "asked")
    mixed = asked.filter("not agrees").groupBy("key").agg(F.max("parts").alias("parts"))
    dealt = _in_pairs(spread_join(tables, mixed, ["key"], ["cid"]), "cid").select("key", "p", "q", "cid", "sketch")

    def forest(table: pa.Table) -> pa.Table:
        return _forest(table, most)

    found = dealt.groupBy("key", "p", "q").applyInArrow(forest, "a long, b long")
    # A class meets a head or the least of a tree in each of many tables: it keeps its least one, and the others that it ties to that one go on among themselves.
    edges = _contracted(_contracted(asked.filter("agrees").select(F.col("cid").alias("a"), F.col("head").alias("b")).union(found)))
    out = connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    discard(tables, asked)
    return out


def _in_pairs(members: DataFrame, deal: str) -> DataFrame:
    """members (with parts) dealt so that every two parts of a group, and each part with itself, meet in one (p, q)."""
    part = F.pmod(F.xxhash64(deal), F.col("parts")).cast("int")
    both = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.filter("parts = 1 or part <> other").withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))


def _links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct sets: 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
    common = df[term] > 1
    term, owner = term[common], owner[common]
    order = np.argsort(term, kind="stable")
    posted = owner[order]
    begin = np.searchsorted(term[order], np.arange(len(df) + 1))
    mine = np.searchsorted(owner, np.arange(len(sets) + 1))
    root = np.arange(len(sets))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets)):
        own = term[mine[i] : mine[i + 1]]
        n = begin[own + 1] - begin[own]
        if not len(own):
            continue
        at = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posted[at], minlength=len(sets))
        linked = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
        for j in linked[linked < i]:
            x, y = top(i), top(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                yield i, int(j)


def _verify(table: pa.Table, k: int, percent: int) -> pa.Table:
    """(a, b) of the links found; with b null the members of a family of several parts that are not connected with its hub."""
    table = table.combine_chunks()
    cids, digests = table.column("cid").to_pylist(), table.column("digest").to_pylist()
    sets: dict[int, np.ndarray] = {}
    n = 0
    for _, _, buf, offsets in slices(table.column("text").combine_chunks()) if len(table) else ():
        for s in shingle_sets(buf, offsets, k):
            if cids[n] not in sets and digest(s) == digests[n]:
                sets[cids[n]] = s
            n += 1
    ids = list(sets)
    edges = [(ids[i], ids[j]) for i, j in _links(list(sets.values()), percent)] if len(ids) > 1 else []
    if len(table) and table.column("parts")[0].as_py() > 1:
        near, grown = {table.column("hub")[0].as_py()}, True
        while grown:
            more = {x for e in edges if (e[0] in near) != (e[1] in near) for x in e}
            grown = not more <= near
            near |= more
        edges += [(x, None) for x in ids if x not in near]
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})


def _links_of(docs: DataFrame, classes: DataFrame, families: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): cids of linked classes, enough of them to connect all that are linked."""
    members = classes.select("digest", "cid", "rep", "rep_hash", "n_shingles").join(families, "cid")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("cid").alias("hub"))
    parts = F.greatest(F.ceil(F.col("n") / PART_TEXTS), F.ceil(F.col("weight") / PART_SHINGLES)).cast("int")
    dealt = spread_join(members, sizes.select("family", "hub", parts.alias("parts")), ["family"], ["cid"])
    dealt = materialise(dealt.select("cid", "digest", "rep", "rep_hash", "family", "hub", "parts", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part")), "dealt")

    # Texts of members only: a bounded filter leaves nearly all others where they are, and no other text is shuffled.
    place = F.xxhash64("rep", "rep_hash").alias("place")
    asked = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("rep_hash"), F.col("text").cast("binary").alias("text"))
    asked = marked_by_filter(asked.withColumn("place", place), "place", key_filter(dealt.select(place), "place")).filter("_maybe").drop("_maybe", "place")
    # Members grow with the corpus, so this join is never a broadcast, however small the first inputs are.
    texts = materialise(asked.join(dealt.hint("merge"), ["rep", "rep_hash"]).select("cid", "digest", "text", "family", "hub", "parts", "part"), "texts")

    def verify(table: pa.Table) -> pa.Table:
        return _verify(table, words, percent)

    columns = ["cid", "digest", "text", "hub", "parts"]
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    met = texts.withColumn("part", F.explode(F.when(F.col("cid") == F.col("hub"), all_parts).otherwise(F.array("part"))))
    first = materialise(met.select("family", "part", *columns).groupBy("family", "part").applyInArrow(verify, "a long, b long"), "links")
    out = first.filter("b is not null")
    apart = first.filter("b is null").select(F.col("a").alias("cid"))
    if apart.isEmpty():
        discard(dealt, texts)
        return out

    # What its part and the hub have not connected with the hub meets all parts of the family.
    far = texts.join(apart.distinct(), "cid", "left_semi").select("cid", "family").distinct()
    rounds = far.groupBy("family").agg(F.ceil(F.count("*") / PART_TEXTS).cast("int").alias("rounds"))
    far = materialise(spread_join(far, rounds, ["family"], ["cid"]), "far")
    theirs = far.select("cid", F.pmod(F.xxhash64("cid", F.lit(1)), "rounds").cast("int").alias("round"))
    ours = texts.join(theirs, "cid").withColumn("part", F.explode(all_parts)).select("family", "round", "part", *columns)
    others = spread_join(texts, far.select("family", "rounds").distinct(), ["family"], ["cid"])
    others = others.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).select("family", "round", "part", *columns)
    second = ours.union(others).groupBy("family", "round", "part").applyInArrow(verify, "a long, b long")
    out = materialise(out.union(second.filter("b is not null")), "links")
    discard(dealt, texts, first, far)
    return out


def _signed_and_linked(docs: DataFrame, words: int, percent: int, h: int, t: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    signed = materialise(signatures(docs, words, h, t), "signed")
    classes, _ = classes_of(signed, "left", "right", "sketch")
    return signed, classes, _links_of(docs, classes, _families(classes, h, t), words, percent)


def labelled_rows(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of signed, by the links (a, b) of classes."""
    rows = signed.filter("digest is not null and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    many = rows.join(several, "doc_id").distinct().join(classes.select("digest", "cid"), "digest")
    least = many.groupBy("doc_id").agg(F.min("cid").alias("least"))
    same = many.join(least, "doc_id").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    groups = connected_components(links.union(same))
    named = classes.select("digest", "cid", "rep").join(groups, classes.cid == groups.node, "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = spread_join(named.select("digest", "component"), least, ["component"], ["digest"], merge=True).select("digest", "least")
    out = spread_join(signed.select("doc_id", "n_shingles", "digest"), named, ["digest"], ["doc_id"], "left", merge=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, h: int = 3, t: int = 15) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; further columns are ignored).

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id each give a row; they are one
    document, so what one of its texts is linked with is linked with all that its other texts are linked with. A row with a
    null doc_id is its own component (null) and is kept. An empty table gives an empty table. Long texts count whole.
    """
    signed, classes, links = _signed_and_linked(docs, words, percent, h, t)
    return labelled_rows(signed, classes, links)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, h: int = 3, t: int = 15) -> DataFrame:
    """One row of each group of texts that are linked: that of the least doc_id, then of the least digest. Columns unchanged.

    Here the texts are linked, not the doc_ids: of two different texts under one doc_id none goes for the other's sake. Rows
    that repeat doc_id and text count as copies. Texts without words and rows with a null doc_id all stay. Clashing names
    of further columns do no harm; an empty table gives an empty table.
    """
    signed, classes, links = _signed_and_linked(docs, words, percent, h, t)
    groups = connected_components(links)
    named = classes.select("digest", "cid", "rep", "rep_hash").join(groups, classes.cid == groups.node, "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min(F.struct("rep", "digest", "rep_hash")).alias("first"))
    first = first.select("first.digest", F.col("first.rep").alias("doc_id"), F.col("first.rep_hash").alias("text_hash"), F.lit(True).alias("stays"))
    rows = signed.filter("digest is not null and doc_id is not null").groupBy("doc_id", "text_hash", "digest").agg(F.count("*").alias("n"))
    judged = spread_join(rows, first, ["digest", "doc_id", "text_hash"], ["doc_id"], "left", merge=True)
    # Rows to look at: those that go, and those that stay but are there several times.
    judged = judged.filter("stays is null or n > 1").select("doc_id", "text_hash", F.coalesce("stays", F.lit(False)).alias("stays"), F.xxhash64("doc_id", "text_hash").alias("place"))
    judged = materialise(judged, "judged")

    text_hash = F.xxhash64("text")
    wrapped = docs.select(F.struct("*").alias("row"), "doc_id", text_hash.alias("text_hash"), F.xxhash64("doc_id", text_hash).alias("place"))
    asked = marked_by_filter(wrapped, "place", key_filter(judged, "place"))
    looked = asked.filter("_maybe and doc_id is not null").join(judged.drop("place"), ["doc_id", "text_hash"], "left")
    single = looked.filter("stays is null").select("row.*")
    repeated = looked.filter("stays").dropDuplicates(["doc_id", "text_hash"]).select("row.*")
    return asked.filter("not _maybe or doc_id is null").select("row.*").union(single).union(repeated)
