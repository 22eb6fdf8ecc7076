"""Prefix trie of conversations, built level by level and rolled up level by level.

A node of depth d goes by (d, least conv_id of its members): nodes of one depth part the conversations among them.

1. `ordered_turns`: turns are sorted by range of (conv_id, turn), so that a long conversation is dealt among tasks, and are
   numbered within a task as they stream by; a conversation that began in an earlier partition goes on counting from what
   those partitions hold of it (at most one such conversation a partition, so these offsets may be broadcast).
2. `rebuilt_turns`: what each conversation starts with is taken from the first conversation of its group.
3. Conversations of equal turns are one class with its number of members: copies cost one row a task from here on.
4. `_levels`, top down: at each depth the live classes meet their next turn and are grouped by (parent, next turn), which
   gives the nodes of that depth. A class stays live while its node has another class. One that is alone is a chain from
   there on, whose nodes follow from its turns without further levels; so there are as many levels as the longest beginning
   that two different conversations share.
5. `_rolled_up`, bottom up: children, leaves and savings of a depth are added to their parents by joins of two levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, spread_join

#: A conversation shares at most so many turns with the first of its group of GROUP ids.
MOST_SHARED, GROUP = 3, 20
#: Ids of a class that are hashed at a time.
CHUNK = 1 << 16
NO_IDS = hashlib.sha256(b"").hexdigest()


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group: unsigned crc32 of its decimal id, modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def first_of_group(conv_id: Column) -> Column:
    return conv_id - conv_id % GROUP


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id -> conv_id, key, words, part, at (place in its conversation, from 1), upto (words so far), both within this task."""
    part, conv, at, upto = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        place, total = np.arange(len(ids)) - starts[run] + 1, np.cumsum(words)
        total = total - (total[starts] - words[starts])[run]
        if ids[0] == conv:  # goes on from the batch before
            place, total = place + np.where(run == 0, at, 0), total + np.where(run == 0, upto, 0)
        conv, at, upto = ids[-1], place[-1], total[-1]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(ids), part, np.int32)), pa.array(place), pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "key", "words", "part", "at", "upto"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ...), key (digest of role and text), words, upto (words of the conversation through this turn)."""
    spark = conversations.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key")
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key, word_count(text).cast("long").alias("words"))
    # Rows that are equal in all else are told apart, so that no run of them is bound to one task.
    turns = materialise(turns.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key", "row"]
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = materialise(dealt.select("conv_id", "key", "words").mapInArrow(_numbered, "conv_id long, key binary, words long, part int, at long, upto long"), "numbered")
    discard(turns)
    # A partition holds the rest of at most one conversation that began before it: at most one row a partition.
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    spans = ends.select(F.col("first").alias("conv_id")).intersect(ends.select(F.col("last").alias("conv_id")))
    held = numbered.join(F.broadcast(spans), "conv_id").groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max("upto").alias("w"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("conv_id", "part", F.sum("n").over(before).alias("n"), F.sum("w").over(before).alias("w")).filter("n is not null")
    zero = F.lit(0).cast("long")
    out = numbered.join(F.broadcast(materialise(offsets, "offsets")), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("at") + F.coalesce("n", zero)).alias("at"), "key", "words", (F.col("upto") + F.coalesce("w", zero)).alias("upto"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, words, upto) of the rebuilt conversations, and (conv_id) of all conversations, turnless ones too."""
    few = turns.filter(F.col("at") <= MOST_SHARED).select("conv_id", F.struct("at", "key", "words", "upto").alias("turn"))
    heads = materialise(few.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("head")), "heads")  # at most three turns each
    h, base = shared_turns(F.col("conv_id")), first_of_group(F.col("conv_id"))
    ours = heads.select("conv_id", base.alias("base"), h.alias("h"), "head")
    theirs = heads.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("start"))
    start = F.slice(F.coalesce("start", F.array().cast(heads.schema["head"].dataType)), 1, F.greatest("h", F.lit(0)))
    own = F.slice("head", 1, F.col("h"))
    words = lambda turns_: F.coalesce(F.element_at(turns_, -1)["upto"], F.lit(0).cast("long"))
    joined = ours.join(theirs, "base", "left").select("conv_id", "h", start.alias("start"), own.alias("own"))
    plan = materialise(joined.select("conv_id", "h", "start", (F.size("start") - F.col("h")).alias("shift"), (_last(words, "start") - _last(words, "own")).alias("more")), "plan")
    started = plan.select("conv_id", F.explode("start").alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.key", "t.words", "t.upto")
    rest = spread_join(turns, plan.select("conv_id", "h", "shift", "more"), ["conv_id"], ["at"], merge=True).filter(F.col("at") > F.col("h"))
    rest = rest.select("conv_id", (F.col("at") + F.col("shift")).alias("depth"), "key", "words", (F.col("upto") + F.col("more")).alias("upto"))
    return started.unionByName(rest), plan.select("conv_id")


def _last(words, turns: str) -> Column:
    return F.when(F.size(turns) > 0, words(F.col(turns))).otherwise(F.lit(0).cast("long"))


def _classes(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal conversations (rep, weight, n_turns, total), and (conv_id, rep) of the members of classes of several."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key")).alias(name) for seed, name in ((1, "x1"), (2, "x2"))]
    digests = rebuilt.groupBy("conv_id").agg(*mark, F.count("*").alias("n_turns"), F.max("upto").alias("total"))
    zero = F.lit(0).cast("long")
    filled = [F.coalesce(c, zero).alias(c) for c in ("x1", "x2", "n_turns", "total")]
    each = materialise(convs.join(digests, "conv_id", "left").select("conv_id", *filled), "digests")
    classes = each.groupBy("x1", "x2", "n_turns", "total").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialise(classes, "classes")
    several = classes.filter("weight > 1").select("x1", "x2", "n_turns", "rep")
    return classes.drop("x1", "x2"), spread_join(each.drop("total"), several, ["x1", "x2", "n_turns"], ["conv_id"], merge=True).select("conv_id", "rep")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, conv_id) -> (rep, first, ids): the decimal ids of runs of a class, comma-joined, at most CHUNK at a time."""
    for batch in batches:
        reps, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.append(True, reps[1:] != reps[:-1])) if len(reps) else np.empty(0, int)
        bounds = np.unique(np.concatenate([cuts, np.arange(0, len(reps), CHUNK), [len(reps)]]).astype(int))
        rows = [(reps[lo], ids[lo], ",".join(map(str, ids[lo:hi].tolist()))) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["rep", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, first) -> (rep, sha): SHA-256 goes through a class's ids piece by piece, and never holds them all."""
    rep, sha = None, None
    for batch in batches:
        out: list[tuple] = []
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if r != rep:
                if sha is not None:
                    out.append((rep, sha.hexdigest()))
                rep, sha = r, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["rep", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], names=["rep", "sha"])


def _ends(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, n_turns, sha) of every class: the digest of its members' ids."""
    members = materialise(members, "members")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.select("rep", "conv_id").repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_joined_ids, "rep long, first long, ids string")
    hashed = runs.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(_hashed_ids, "rep long, sha string")
    alone = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    return classes.join(hashed, "rep", "left").select("rep", "n_turns", F.coalesce("sha", alone).alias("sha"))


def _levels(turns: DataFrame, classes: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes of the depths 1, 2, ... that live classes reach, (rep, top) of the classes that are alone from depth top on, and (rep, node) of
    the classes that end in a node which goes by another conversation's id."""
    root = classes.agg(F.min("rep")).first()[0]
    live = classes.select("rep", "weight", F.lit(root).alias("parent"))
    levels: list[DataFrame] = []
    alone: list[DataFrame] = []
    ended = classes.filter("n_turns = 0").select("rep", F.lit(root).alias("node"))
    while True:
        depth = len(levels) + 1
        now = turns.filter(F.col("depth") == depth).select("rep", "key", "words", "before", "total", "n_turns")
        met = materialise(live.join(now, "rep"), "met")
        of_one = [F.max(c).alias(c) for c in ("total", "before", "n_turns")]  # told of nodes of one class only
        grouped = met.groupBy("parent", "key").agg(
            F.min("rep").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_classes"), F.first("words").alias("words"), *of_one
        )
        nodes = materialise(grouped, "nodes")
        if nodes.isEmpty():
            discard(met, nodes)
            break
        levels.append(nodes)
        alone.append(nodes.filter("n_classes = 1").select(F.col("node").alias("rep"), F.lit(depth).alias("top")))
        last, shared = met, nodes.filter("n_classes > 1").select("parent", "key", "node")
        on = materialise(spread_join(met, shared, ["parent", "key"], ["rep"]).select("rep", "weight", "n_turns", "node"), "live")
        ended = ended.union(on.filter(F.col("n_turns") == depth).select("rep", "node"))
        live = on.select("rep", "weight", F.col("node").alias("parent"))
        discard(last)
    out = alone[0] if alone else classes.select("rep", F.lit(0).alias("top")).limit(0)
    for more in alone[1:]:
        out = out.union(more)
    return levels, out, ended


def _rolled_up(levels: list[DataFrame], classes: DataFrame) -> list[DataFrame]:
    """The nodes of every level, the root's too, with what their subtrees hold."""
    zero = F.lit(0).cast("long")
    root = classes.agg(F.min("rep").alias("node"), F.sum("weight").alias("n_convs"), F.count("*").alias("n_classes")).filter("node is not null")
    root = root.select(F.lit(None).cast("long").alias("parent"), "node", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(2).alias("n_classes"), *[zero.alias(c) for c in ("total", "before", "n_turns")])
    below, out = None, []
    for depth, nodes in reversed(list(enumerate([root, *levels]))):
        if below is None:
            joined = nodes.select("*", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"))
        else:
            sums = below.groupBy("parent_conv_id").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            joined = nodes.join(sums, nodes.node == sums.parent_conv_id, "left")
        # A class alone in its node is a chain from there on: its nodes below have one child or none and save what its words say.
        chain = F.col("n_classes") == 1
        saved = F.when(chain, (F.col("n_convs") - 1) * (F.col("total") - F.col("before"))).otherwise((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", zero))
        children = F.when(chain, (F.col("n_turns") > depth).cast("long")).otherwise(F.coalesce("children", zero))
        rolled = joined.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            children.alias("n_children"), F.when(chain, 1).otherwise(F.greatest(F.coalesce("leaves", zero), F.lit(1))).cast("long").alias("n_leaves"), saved.alias("saved_tokens"),
        )
        below = materialise(rolled, "rolled")
        out.append(below)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    conversations (conv_id, turn, role, text); further columns are ignored, whatever their names. Turns go in the order of
    `turn`, null first; equal ones by the MD5 of the role's length, a colon, role and text; rows that repeat are a turn each. Null
    roles and texts are empty; texts count whole. Rows of null conv_id belong to no conversation. An empty table has no root
    and gives an empty table; conversations of no turns, if there are no others, give the root alone, which is its own leaf.
    """
    turns = materialise(ordered_turns(conversations), "ordered")
    rebuilt, convs = rebuilt_turns(turns)
    rebuilt = materialise(rebuilt, "rebuilt")
    classes, members = _classes(rebuilt, convs)
    ends = materialise(_ends(classes, members), "ends")
    if classes.isEmpty():
        levels, alone, ended = [], classes.select("rep", F.lit(0).alias("top")), classes.select("rep", F.col("rep").alias("node"))
    else:
        n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = spread_join(rebuilt, classes.select(F.col("rep").alias("conv_id"), "weight", "n_turns", "total"), ["conv_id"], ["depth"], merge=True)
        own = own.select(F.col("conv_id").alias("rep"), "depth", "key", "words", (F.col("upto") - F.col("words")).alias("before"), "weight", "n_turns", "total")
        own = materialise(own, "own")
        by_depth = materialise(own.repartitionByRange(n, "depth", "rep").sortWithinPartitions("depth"), "by_depth")  # a level reads its own row groups
        discard(own, rebuilt)
        levels, alone, ended = _levels(by_depth, classes)
    rolled = _rolled_up(levels, classes)
    nodes = rolled[0]
    for more in rolled[1:]:
        nodes = nodes.unionByName(more)
    if levels:
        below = spread_join(by_depth, alone, ["rep"], ["depth"], merge=True).filter("depth > top")
        one = F.lit(1).cast("long")
        chained = below.select(
            F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
            (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), ((F.col("weight") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        )
        nodes = nodes.unionByName(chained)
    at = ends.join(ended, "rep", "left").select(F.coalesce("node", "rep").alias("conv_id"), F.col("n_turns").alias("depth"), "sha")
    return nodes.join(at, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_IDS))).drop("sha")
