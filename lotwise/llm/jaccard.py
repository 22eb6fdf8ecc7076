"""Exact similarity join of word-shingle sets, by skipping what set relations make superfluous.

Two distinct sets of sizes n and m link when 100 * overlap >= percent * union, so their overlap is at least
`need(n, m)` = percent * (n + m) / (100 + percent), rounded up, and at least percent of the greater size.

1. Rows of equal sets are one class. Of a class only the q(n) least hashes are sent, about three tenths of the set: two sets
   that link share at least k(n) of them.
2. Those of its sent tokens that are rarest (by the number of classes) are indexed, so many that two sets that link share
   an indexed one. A token that no other class has can't be shared: it only moves the others back. A class whose unshared
   tokens fill its indexed ones has no partner.
3. An index list holds (class, size, position among the sent tokens in order of rarity). Lists are parted in blocks by size
   and position, which are skipped together by what their least sizes and positions allow at most.
4. Answers first come from hubs: in each list every set asks the list's least by a hash; exact overlaps are the hub's
   computed answers, and sets that link are one component. A few such rounds, each with other hubs, leave few components.
5. A set's home is the least hub that it is similar to. Two sets X and Y of one home H derive their answer from H's: the
   tokens in which they differ are those in which just one of them differs from H, so two that link, of which one is not
   linked with H, share at least |X ^ H| less the most tokens in which sets that link differ. This holds for any set in H's
   place, so what most members differ from H in is flipped: they are compared with their consensus. Within a home of several
   components these differences are indexed, rarest first, instead of the sets: what members have in common no longer pairs
   them. Two that are too near to the consensus to share a difference are both linked with the member nearest to it. These
   lists ask hubs of their own first, so that near copies at all distances are one component before pairs are made.
6. Sets of different homes and components meet by blocks of the lists; if both asked the list's hub H, its answers refute
   most pairs: |X n Y| is at most min(|X n H|, |Y n H|) + min(|X - H|, |Y - H|) and at least |X n H| + |Y n H| - |H|.
   A set's mask has a bit for each remainder that its hashes leave; X has at least as many tokens that Y lacks as X's mask has
   bits that Y's lacks. That refutes pairs where they meet. Those that are left open are intersected in full, in even parts.

Every pair of sets that links is linked, refuted by a bound that is exact, or within a component already: no link between
different texts is lost, while a group of g near copies costs about g questions a round and not g * g.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .components import connected_components, drawn_together
from .neardup import classes_of, digest, labelled_rows, shingle_sets
from .shared import discard, key_filter, marked_by_filter, materialise, spread_join
from .words import slices

#: Rounds in which lists ask hubs; a part of a hub's questions holds about so many sets, and so many shingles in all.
HUB_ROUNDS, PART_SETS, PART_SHINGLES = 2, 256, 1_000_000
#: A set may derive answers from a hub of at least this similarity.
HOME_PERCENT = 30
#: A mask's longs, and the columns that hold them.
MASK = [f"m{k}" for k in range(8)]
#: Digests that a task remembers, to send the tokens of a class once.
REMEMBERED = 200_000
#: A token that so many classes have, or more, counts as one of so many.
COUNTED = 1 << 16


def sent(n, percent: int):
    """How many of the least hashes of a set of n are sent (for numbers and for Columns by `sent_column`)."""
    return n - -(-percent * n // 100) + max(1, n // 10)


def sent_column(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / 100).cast("long") + F.greatest(F.lit(1), F.floor(n / 10))


def shared_of_sent(n: Column, percent: int) -> Column:
    """How many sent tokens a set of n shares with any that it links with, at least."""
    return F.greatest(F.lit(1), F.floor(percent * n / 1000))


def need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap at which sets of n and m link."""
    return F.ceil(percent * (n + m) / (100 + percent))


def cid_of(digest_: bytes, seed: int) -> int:
    """The class number that `classes_of` gives a digest: Spark's xxhash64 of the digest and the seed."""
    return xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(digest_, 42))


def mask(shingles: np.ndarray) -> np.ndarray:
    """The longs whose bits say which remainders the hashes of a set leave."""
    bits = np.zeros(64 * len(MASK), np.uint8)
    bits[shingles & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits).view(np.int64)


def not_refuted(x: str, y: str, percent: int) -> Column:
    """Whether the masks of two sets let them link; x and y are prefixes of the columns n and MASK."""
    alone = lambda a, b: reduce(add, [F.bit_count(F.col(f"{a}{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}{c}")))) for c in MASK])
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return F.least(n - alone(x, y), m - alone(y, x)) >= need(n, m, percent)


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, masks = [], [], []
        for _, _, buf, offsets in slices(batch.column(2)):
            for s in shingle_sets(buf, offsets, k):
                sizes.append(len(s))
                digests.append(digest(s))
                masks.append(mask(s))
        bits = np.array(masks, np.int64).reshape(-1, len(MASK))
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *[pa.array(np.ascontiguousarray(c)) for c in bits.T]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "digest", *MASK])


def _sent_tokens(batches: Iterator[pa.RecordBatch], k: int, percent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(token, cid) of the sent tokens of every class, once a task."""
    told: set[bytes] = set()
    for batch in batches:
        for _, _, buf, offsets in slices(batch.column(0)):
            tokens, cids, sizes = [np.empty(0, np.uint64)], [], []
            for s in shingle_sets(buf, offsets, k):
                d = digest(s)
                if d is None or d in told:
                    continue
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add(d)
                tokens.append(s[: sent(len(s), percent)])
                cids.append(cid_of(d, seed))
                sizes.append(len(tokens[-1]))
            owner = np.repeat(np.array(cids, np.uint64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(owner.view(np.int64))], names=["token", "cid"])


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (token, cid) in that order, rows that may repeat: each once, with df, of the tokens that several classes have."""

    def told(token: np.ndarray, cid: np.ndarray, begun: bool) -> pa.RecordBatch:
        """begun: the first token is one of COUNTED or more, and its row here is sent already."""
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.diff(np.append(first, len(token)))
        df = np.minimum(n, COUNTED)
        if begun:
            df[0] = COUNTED
        df = np.repeat(df, n)
        kept = df > 1
        if begun:
            kept[0] = False
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (token, cid, df)], names=["token", "cid", "df"])

    token, cid, begun = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        token, cid = np.append(token, batch.column(0).to_numpy()), np.append(cid, batch.column(1).to_numpy())
        fresh = np.append(True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1]))
        token, cid = token[fresh], cid[fresh]
        last = int(np.searchsorted(token, token[-1]))  # where the token begins that the next batch may go on with
        if len(token) - last >= COUNTED or (begun and not last):
            yield told(token, cid, begun)
            token, cid, begun = token[-1:], cid[-1:], True
        elif last:
            yield told(token[:last], cid[:last], begun)
            token, cid, begun = token[last:], cid[last:], False
    if len(token):
        yield told(token, cid, begun)


def _index(docs: DataFrame, classes: DataFrame, seed: int, words: int, percent: int) -> DataFrame:
    """(token, cid, n, q, i): the lists, of the tokens that several rows sent; i is the token's position (from 0) among the q sent ones."""
    texts = docs.filter("doc_id is not null").select(F.col("text").cast("binary").alias("text"))
    rows = texts.mapInArrow(partial(_sent_tokens, k=words, percent=percent, seed=seed), "token long, cid long")
    # Sorted, a token's classes stream through a task that holds COUNTED of them at most.
    dealt = rows.repartition("token").sortWithinPartitions("token", "cid")
    shared = materialise(dealt.mapInArrow(_shared_tokens, "token long, cid long, df long"), "shared")
    sizes = classes.select("cid", F.col("n_shingles").alias("n"))
    most = shared.groupBy("cid").agg(F.count("*").alias("m")).join(sizes, "cid")
    q = sent_column(F.col("n"), percent)
    # In order of rarity the tokens that no other class has come first, so of the indexed ones fewer are left to shared tokens.
    asking = most.select("cid", "n", q.alias("q"), "m", (F.col("m") - shared_of_sent(F.col("n"), percent) + 1).alias("take")).filter("take > 0")
    ranked = shared.join(asking, "cid").withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy("df", "token")))
    index = ranked.filter("rank <= take").select("token", "cid", "n", "q", (F.col("q") - F.col("m") + F.col("rank") - 1).alias("i"))
    out = materialise(index, "index")
    discard(shared)
    return out


def possible(x: str, y: str, percent: int) -> Column:
    """Whether two sets that meet in a list can link, by sizes and positions; x and y are prefixes of columns n, q, i."""
    n, m, q, p, i, j = (F.col(c) for c in (f"{x}n", f"{y}n", f"{x}q", f"{y}q", f"{x}i", f"{y}i"))
    fits = (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (F.least(q - i, p - j) >= F.greatest(F.lit(1), need(n, m, percent) + F.least(q - n, p - m)))
    return fits


def _overlaps(table: pa.Table, k: int) -> pa.Table:
    """Of one part of a hub's questions: (a, b, n_a, n_b, both) for every set asked about."""
    table = table.combine_chunks()
    sets = [s for _, _, buf, offsets in slices(table.column("text").combine_chunks()) for s in shingle_sets(buf, offsets, k)] if len(table) else []
    hub = next((s for s, own in zip(sets, table.column("own").to_pylist(), strict=True) if own), np.empty(0, np.uint64))
    rows = []
    for s, cid, b, own in zip(sets, table.column("cid").to_pylist(), table.column("b").to_pylist(), table.column("own").to_pylist(), strict=True):
        if not own:
            at = np.minimum(np.searchsorted(hub, s), max(len(hub) - 1, 0))
            rows.append((cid, b, len(s), len(hub), int((hub[at] == s).sum()) if len(hub) else 0))
    return pa.table({name: pa.array([r[c] for r in rows], pa.int64()) for c, name in enumerate(("a", "b", "n_a", "n_b", "both"))})


def _differences(table: pa.Table, k: int) -> pa.Table:
    """Of one part of a hub's members: (b, cid, token) of the tokens that a member or the hub has alone."""
    table = table.combine_chunks()
    sets = [s for _, _, buf, offsets in slices(table.column("text").combine_chunks()) for s in shingle_sets(buf, offsets, k)] if len(table) else []
    hub = next((s for s, own in zip(sets, table.column("own").to_pylist(), strict=True) if own), np.empty(0, np.uint64))
    told = [(np.setxor1d(s, hub, assume_unique=True), cid) for s, cid, own in zip(sets, table.column("cid").to_pylist(), table.column("own").to_pylist(), strict=True) if not own]
    tokens = np.concatenate([np.empty(0, np.uint64), *[t for t, _ in told]])
    owner = np.repeat(np.array([cid for _, cid in told], np.int64), [len(t) for t, _ in told])
    b = table.column("b")[0].as_py() if len(table) else 0
    return pa.table({"b": np.full(len(tokens), b, np.int64), "cid": owner, "token": tokens.view(np.int64)})


def _dealt(pairs: DataFrame, texts: DataFrame) -> GroupedData:
    """pairs (a, b) with their texts: b's in even parts (b, part), each with the text of b itself."""
    load = pairs.join(texts.select(F.col("cid").alias("a"), "n"), "a").groupBy("b").agg(F.count("*").alias("asked"), F.sum("n").alias("weight"))
    parts = load.select("b", F.greatest(F.ceil(F.col("asked") / PART_SETS), F.ceil(F.col("weight") / PART_SHINGLES)).cast("int").alias("parts"))
    dealt = spread_join(pairs, parts, ["b"], ["a"]).select(F.col("a").alias("cid"), "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(False).alias("own"))
    hubs = parts.select(F.col("b").alias("cid"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"))
    return dealt.union(hubs).join(texts.select("cid", "text").hint("merge"), "cid").groupBy("b", "part")


def _answers(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (a, b) -> (a, b, n_a, n_b, both): exact overlaps."""

    def overlaps(table: pa.Table) -> pa.Table:
        return _overlaps(table, words)

    return materialise(_dealt(pairs, texts).applyInArrow(overlaps, "a long, b long, n_a long, n_b long, both long"), "answers")


def _linked(answers: DataFrame, percent: int) -> DataFrame:
    return answers.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _in_components(index: DataFrame, links: DataFrame, settled: bool = False) -> tuple[DataFrame, DataFrame]:
    """index with comp: classes of one comp are linked by chains (all that are have one, if settled); and links that connect the same, fewer of them."""
    if settled:
        leasts = connected_components(links).select("node", F.col("component").alias("least"))
        links = leasts.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    else:
        links, leasts = drawn_together(links)
    groups = leasts.select(F.col("node").alias("cid"), F.col("least").alias("comp"))
    return index.join(groups, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), links


def _hub_questions(index: DataFrame, round_: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): what sets ask the hubs of their lists that are in other components; and (token, hub) of those lists."""
    head = F.min(F.struct(F.xxhash64("cid", F.lit(round_)).alias("h"), "cid", "n", "q", "i", "comp")).alias("head")
    several = index.groupBy("token").agg(head, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    hubs = several.select("token", *[F.col(f"head.{c}").alias(f"hub_{c}") for c in ("cid", "n", "q", "i", "comp")])
    met = spread_join(index, hubs, ["token"], ["cid"]).filter("comp <> hub_comp").filter(possible("", "hub_", percent))
    return met.select(F.col("cid").alias("a"), F.col("hub_cid").alias("b")).distinct(), hubs.select("token", F.col("hub_cid").alias("hub"))


def _block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(token, s, p, s2, p2): pairs of blocks of one list that may hold sets of different components and homes that link."""
    blocks = entries.groupBy("token", "s", "p").agg(
        F.min("n").alias("n"), F.max(F.col("q") - F.col("i")).alias("room"), F.min(F.col("q") - F.col("n")).alias("short"),
        *[f(c).alias(f"{name}_{c}") for c in ("comp", "home") for name, f in (("lo", F.min), ("hi", F.max))],
    )
    bounds = ("lo_comp", "hi_comp", "lo_home", "hi_home")
    theirs = blocks.select("token", F.col("s").alias("s2"), F.col("p").alias("p2"), *[F.col(c).alias(f"{c}2") for c in ("n", "room", "short", *bounds)])
    near = blocks.withColumn("s2", F.explode(F.array("s", F.col("s") + 1))).join(theirs, ["token", "s2"]).filter("s < s2 or p <= p2")
    least = F.greatest(F.lit(1), need(F.col("n"), F.col("n2"), percent) + F.least("short", "short2"))
    one = lambda c: (F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.col(f"lo_{c}2") == F.col(f"hi_{c}2")) & (F.col(f"lo_{c}") == F.col(f"lo_{c}2"))
    return near.filter(~one("comp") & ~one("home") & (F.least("room", "room2") >= least)).select("token", "s", "p", "s2", "p2")


def _open_pairs(index: DataFrame, hubs: DataFrame, answers: DataFrame, masks: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of the pairs of different homes that blocks, masks and the hubs' answers don't refute; sure: the answers say that they link."""
    lists = index.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    several = spread_join(index, lists, ["token"], ["cid"])
    told = spread_join(several, hubs, ["token"], ["cid"], "left").join(answers.select(F.col("a").alias("cid"), F.col("b").alias("hub"), F.col("n_b").alias("hub_n"), "both"), ["cid", "hub"], "left")
    told = told.join(masks, "cid")
    size_block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("s")  # sizes that link are in one block or in two neighbours
    entries = told.select("token", "cid", "n", "q", "i", "comp", "home", "hub_n", "both", *MASK, size_block, F.floor(F.log2(F.col("i") + 1.0)).alias("p"))
    entries = materialise(entries, "entries")
    pairs = _block_pairs(entries, percent)
    ours = entries.join(pairs, ["token", "s", "p"]).select("token", "s2", "p2", (F.col("s") == F.col("s2")).alias("alike"), (F.col("p") == F.col("p2")).alias("same"), *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "q", "i", "comp", "home", "hub_n", "both", *MASK)])
    theirs = entries.select("token", F.col("s").alias("s2"), F.col("p").alias("p2"), *[F.col(c).alias(f"y_{c}") for c in ("cid", "n", "q", "i", "comp", "home", "both", *MASK)])
    met = ours.join(theirs.hint("merge"), ["token", "s2", "p2"]).filter("x_comp <> y_comp and x_home <> y_home and (not (alike and same) or x_cid < y_cid)").filter(possible("x_", "y_", percent)).filter(not_refuted("x_", "y_", percent))
    least = need(F.col("x_n"), F.col("y_n"), percent)
    most = F.least("x_both", "y_both") + F.least(F.col("x_n") - F.col("x_both"), F.col("y_n") - F.col("y_both"))
    both_told = F.col("x_both").isNotNull() & F.col("y_both").isNotNull()
    sure = F.coalesce(F.col("x_both") + F.col("y_both") - F.col("x_hub_n") >= least, F.lit(False))
    met = met.filter(~both_told | (most >= least)).select(F.greatest("x_cid", "y_cid").alias("a"), F.least("x_cid", "y_cid").alias("b"), sure.alias("sure"))
    return met.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _homes(told: DataFrame) -> DataFrame:
    """(cid, home) of the sets that asked: of the hubs that a set is similar to and itself, the least by the first round's hash."""
    near = told.filter(100 * F.col("both") >= HOME_PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select(F.col("a").alias("cid"), F.col("b").alias("hub"))
    near = near.union(near.select("cid", F.col("cid"))).union(near.select("hub", F.col("hub")))
    return near.groupBy("cid").agg(F.min_by("hub", F.struct(F.xxhash64("hub", F.lit(0)), "hub")).alias("home"))


def _home_pairs(members: DataFrame, links: DataFrame, texts: DataFrame, masks: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): sets of one home and different components that share enough of their differences from it; members (cid, n, comp, home).

    Before, hubs of the lists of differences are asked; what they link is added to the links (a, b) given, and links that connect the same are given back as well.
    """
    several = members.groupBy("home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("home")
    asked = materialise(spread_join(members.filter("cid <> home"), several, ["home"], ["cid"]), "members")

    def differences(table: pa.Table) -> pa.Table:
        return _differences(table, words)

    told = _dealt(asked.select(F.col("cid").alias("a"), F.col("home").alias("b")), texts).applyInArrow(differences, "b long, cid long, token long")
    told = materialise(told.select(F.col("b").alias("home"), "cid", "token"), "differences")
    # What most members differ in moves from the members to what they are compared with: their consensus instead of the hub.
    counts = told.groupBy("home", "token").agg(F.count("*").alias("df")).join(asked.groupBy("home").agg(F.count("*").alias("size")), "home")
    usual = materialise(counts.filter("2 * df > size").select("home", "token"), "usual")
    ours = spread_join(told, usual.withColumn("usual", F.lit(True)), ["home", "token"], ["cid"], "left").filter("usual is null").drop("usual")
    lacking = asked.select("home", "cid").join(usual, "home").join(told.hint("merge"), ["home", "cid", "token"], "left_anti")
    own = materialise(ours.unionByName(lacking), "own")
    discard(told)
    told = own
    shared = told.groupBy("home", "token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = materialise(spread_join(told, shared, ["home", "token"], ["cid"]), "shared")
    sizes = told.groupBy("cid").agg(F.count("*").alias("d")).join(shared.groupBy("cid").agg(F.count("*").alias("m")), "cid")
    least = F.greatest(F.lit(1), F.col("d") - F.floor((100 - percent) * F.col("n") / percent))
    taking = sizes.join(asked.select("cid", "n", "comp"), "cid").select("cid", "n", "comp", "d", "m", (F.col("m") - least + 1).alias("take")).filter("take > 0")
    ranked = shared.join(taking, "cid").withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy("df", "token")))
    rest = (F.col("m") - F.col("rank") + 1).alias("rest")  # differences from this one on, in order of rarity
    lists = materialise(ranked.filter("rank <= take").select("home", "token", "cid", "n", "d", "comp", rest).join(masks, "cid"), "lists")
    most = F.col("n") + F.col("y_n") - 2 * need(F.col("n"), F.col("y_n"), percent)  # tokens in which two that link differ
    enough = F.least("rest", "y_rest") >= F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("y_d") - most) / 2))
    may = enough & (percent * F.greatest("n", "y_n") <= 100 * F.least("n", "y_n")) & not_refuted("", "y_", percent)
    told_of = ("cid", "n", "d", "comp", "rest", *MASK)
    for round_ in range(HUB_ROUNDS):
        head = F.min(F.struct(F.xxhash64("cid", F.lit(round_)).alias("h"), *told_of)).alias("head")
        mixed = lists.groupBy("home", "token").agg(head, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        hubs = mixed.select("home", "token", *[F.col(f"head.{c}").alias(f"y_{c}") for c in told_of])
        met = spread_join(lists, hubs, ["home", "token"], ["cid"]).filter("comp <> y_comp").filter(may)
        links = links.union(_linked(_answers(materialise(met.select(F.col("cid").alias("a"), F.col("y_cid").alias("b")).distinct(), "questions"), texts, words), percent))
        # Before pairs are made components are settled: sets of one that had different ones would be paired with each other.
        now, links = _in_components(lists.drop("comp"), links, settled=round_ == HUB_ROUNDS - 1)
        last, lists = lists, materialise(now, "lists")
        discard(last)
    mixed = lists.groupBy("home", "token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("home", "token")
    ours = spread_join(lists, mixed, ["home", "token"], ["cid"])
    theirs = lists.select("home", "token", *[F.col(c).alias(f"y_{c}") for c in told_of])
    met = ours.join(theirs.hint("merge"), ["home", "token"]).filter("comp <> y_comp and cid > y_cid").filter(may)
    # Two that are so near to the consensus that they need share no difference are both linked with the member that is nearest to it.
    far = asked.join(told.groupBy("cid").agg(F.count("*").alias("d")), "cid", "left").select("home", "cid", "comp", "n", ((100 + percent) * F.coalesce("d", F.lit(0)) - (100 - percent) * F.col("n")).alias("far"))
    nearest = far.groupBy("home").agg(F.min(F.struct("far", "cid", "comp")).alias("least")).select("home", "least.*")
    star = spread_join(far.select("home", "cid", "comp"), nearest.select("home", F.col("cid").alias("b"), F.col("comp").alias("comp2"), F.col("far").alias("far2")), ["home"], ["cid"])
    star = star.filter("comp <> comp2 and cid <> b").select(F.col("cid").alias("a"), "b")
    out = materialise(met.select(F.col("cid").alias("a"), F.col("y_cid").alias("b")).union(star).distinct(), "pairs")
    discard(told, shared, lists, usual)
    return out, links


def _texts(docs: DataFrame, classes: DataFrame, index: DataFrame) -> DataFrame:
    """(cid, n, text) of the classes that are in the index, each by one row; no other text is shuffled while the filter is sparse."""
    asked = classes.join(index.select("cid").distinct(), "cid").select("cid", F.col("n_shingles").alias("n"), F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash"))
    asked = materialise(asked.withColumn("place", F.xxhash64("doc_id", "text_hash")), "asked")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = marked_by_filter(rows.withColumn("place", F.xxhash64("doc_id", "text_hash")), "place", key_filter(asked, "place")).filter("_maybe").drop("_maybe", "place")
    return materialise(rows.join(asked.drop("place").hint("merge"), ["doc_id", "text_hash"]).select("cid", "n", "text").dropDuplicates(["cid"]), "texts")


def _not_told(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """The pairs (a, b) that no answer holds either way."""
    return pairs.join(told.select("a", "b"), ["a", "b"], "left_anti").join(told.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def links_of(docs: DataFrame, classes: DataFrame, seed: int, words: int, percent: int) -> DataFrame:
    """(a, b): links of classes, enough of them to connect all that are linked."""
    index = _index(docs, classes, seed, words, percent)
    texts = _texts(docs, classes, index)
    now, links, told, hubs_told = index.withColumn("comp", F.col("cid")), None, None, None
    for round_ in range(HUB_ROUNDS):
        asked, hubs = _hub_questions(now, round_, percent)
        if told is None:
            hubs_told = materialise(hubs, "hubs")
        else:
            asked = _not_told(asked, told)
        answers = _answers(materialise(asked, "questions"), texts, words)
        told = answers if told is None else told.union(answers)
        found = _linked(answers, percent)
        links = found if links is None else links.union(found)
        if round_ < HUB_ROUNDS - 1:  # after the last round the homes' answers come first
            now, links = _in_components(index, links)
            now = materialise(now, "index")
    # A set whose home has itself another home asks that one too: so most sets of a large group come to have one home.
    homes = materialise(_homes(told), "homes")
    moved = spread_join(homes, homes.select(F.col("cid").alias("home"), F.col("home").alias("further")).filter("home <> further"), ["home"], ["cid"])
    asked = _not_told(moved.filter("cid <> further").select(F.col("cid").alias("a"), F.col("further").alias("b")), told)
    answers = _answers(materialise(asked, "questions"), texts, words)
    told, links = told.union(answers), links.union(_linked(answers, percent))
    now, links = _in_components(index, links)
    own = index.select("cid", "n").distinct().select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("both"))
    # A hub knows its own overlap with itself, so that its list's answers hold for it as well.
    known = told.union(own).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("n_a", "n_b", "both")])
    now = now.join(_homes(told), "cid", "left").withColumn("home", F.coalesce("home", "cid"))
    now = materialise(now, "index")
    masks = classes.join(texts.select("cid"), "cid", "left_semi").select("cid", *MASK)
    within, links = _home_pairs(now.select("cid", "n", "comp", "home").distinct(), links, texts, masks, words, percent)
    settled = links.select(F.col("a").alias("cid"), F.col("b").alias("least"))  # stars, as homes' lists asked last
    now = now.join(settled, "cid", "left").withColumn("comp", F.coalesce("least", "cid")).drop("least")
    open_ = materialise(_open_pairs(now, hubs_told, known, masks, percent), "open")
    rest = _answers(open_.filter("not sure").select("a", "b").union(within).distinct(), texts, words)
    return links.union(open_.filter("sure").select("a", "b")).union(_linked(rest, percent))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text; further columns are ignored, whatever their names).

    Null and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id each give a row; they are one
    document, linked with what any of its texts is linked with. A row of null doc_id is its own component (null) and links
    nothing. Texts count whole, whatever their length; an empty table gives an empty table. component_id is the least doc_id reachable.
    """
    sets = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    signed = materialise(sets.mapInArrow(partial(_signed, k=words), "doc_id long, text_hash long, n_shingles long, digest binary, " + ", ".join(f"{c} long" for c in MASK)), "signed")
    classes, seed = classes_of(signed, *MASK)
    return labelled_rows(signed, classes, links_of(docs, classes, seed, words, percent)).select("doc_id", "n_shingles", "component_id")
