"""Connected components of an edge table, by alternating large and small stars, contracted where the edges lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise, spread_join

#: Edges that a task contracts at once.
AT_ONCE = 1_000_000


def _trees(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges x[i] - y[i]."""
    root = np.arange(n)
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        x, y = lo[lo < hi], hi[lo < hi]
        np.minimum.at(root, y, x)
        while not np.array_equal(further := root[root], root):
            root = further
    return root


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each AT_ONCE edges (a, b): every node with the least that it reaches by them."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ends = pa.concat_arrays([c for name in ("a", "b") for c in table.column(name).chunks]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        x, y = np.split(rank[ends.indices.to_numpy()], 2)
        root, names = _trees(x, y, len(order)), ends.dictionary.take(pa.array(order))
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(root[own]))], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= AT_ONCE:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def _where_they_lie(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: each task's edges become stars, so a node keeps about one edge down a task."""
    return edges.mapInArrow(_contracted, edges.schema)


def _unsettled(edges: DataFrame) -> bool:
    """Whether an edge is left that is no ray of a star: its greater end has a second edge, or its lesser end is itself a greater one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = spread_join(both.filter("b > a"), least, ["a"], ["b"])
    return _where_they_lie(near.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    # Contracted edges: of a node's edges down each task sends about one, so no group is larger than the number of tasks.
    near = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    rays = near.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("ray"))
    return rays.select("ray.a", "ray.b").filter("a <> b").distinct()


def _begun(edges: DataFrame) -> DataFrame:
    lying = _where_they_lie(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return materialise(lying.distinct(), "edges")


def _round(edges: DataFrame) -> DataFrame:
    out = materialise(_small_star(_large_star(edges)), "edges")
    discard(edges)
    return out


def drawn_together(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) with the components of those given, one round nearer to stars; and (node, least) of their nodes that have a lesser one.

    Nodes of equal least, and a least itself, are connected; connected ones may still have different leasts. That is enough to
    leave out what lies within a component, and costs no question whether a round was the last.
    """
    now = _round(_begun(edges))
    return now, now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges of any type that has an order -> (node, component): each node that has an edge, with the least it reaches.

    Null ends and edges from a node to itself are no edges; edges may repeat; an empty table gives an empty table. Every round
    is written to the shared folder and the round before it deleted; only whether one was the last reaches the driver. The least
    neighbour of a node is aggregated before the shuffle, and a hub's edges are dealt among several tasks. Tasks contract their
    edges before they send them: few rounds are left, and each is four shuffles.
    """
    now = _begun(edges)
    while _unsettled(now):
        now = _round(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
