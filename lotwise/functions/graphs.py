"""Lists and groups by pointer doubling: as many rounds as the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def list_places(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(list, node, place) of the nodes that a list reaches from its start, from 0 on; each node once, at its first place.

    links (list, node, next), one row a node; starts (list, node). Round by round all known places meet the jumps of 2^k
    links, which double the places that are known, and the jumps are doubled. A list that runs into itself ends there. The
    tables are about as large in each round, so their joins sort: none goes through the driver as a broadcast.
    """
    jumps = written(links.filter("next is not null").select("list", "node", F.col("next").alias("to")), "jumps")
    known = written(starts.join(links.select("list", "node").hint("merge"), ["list", "node"]).distinct().withColumn("place", F.lit(0).cast("long")), "places")
    step = 1
    while True:
        more = known.join(jumps.hint("merge"), ["list", "node"]).select("list", F.col("to").alias("node"), (F.col("place") + step).alias("place"))
        more = more.join(links.select("list", "node").hint("merge"), ["list", "node"], "left_semi")
        # A node that is met again, further on, closes a loop: what is beyond it was met before.
        grown = written(known.union(more).groupBy("list", "node").agg(F.min("place").alias("place")), "places")
        before, after = known.count(), grown.count()
        discard(known)
        known = grown
        if before == after:
            discard(jumps)
            return known
        there = jumps.select("list", F.col("node").alias("to"), F.col("to").alias("further"))
        doubled = written(jumps.join(there.hint("merge"), ["list", "to"]).select("list", "node", F.col("further").alias("to")), "jumps")
        discard(jumps)
        jumps, step = doubled, 2 * step


def groups(edges: DataFrame) -> DataFrame:
    """(node, least) of all nodes of the edges (a, b): the least node that each reaches, whatever their direction.

    Every node points to the least that it knows of; each round it takes over what its neighbours' and its own pointer point
    to. Null ends are no edges; an edge from a node to itself makes it a group of its own.
    """
    both = written(edges.filter("a is not null and b is not null").select("a", "b").union(edges.filter("a is not null and b is not null").select("b", "a")).distinct(), "edges")
    known = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")), "groups")
    while True:
        # The least of the neighbours goes to a node and to what it points to; then pointers are followed once.
        told = both.join(known.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        seen = known.join(told, "node").select("node", "least", F.least("least", "near").alias("near"))
        hooked = seen.select("node", "near").union(seen.select(F.col("least").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("near"))
        jumped = hooked.join(hooked.select(F.col("node").alias("near"), F.col("near").alias("further")), "near").select("node", F.least("near", "further").alias("least"))
        grown = written(jumped, "groups")
        changed = grown.join(known.withColumnRenamed("least", "was"), "node").filter("least < was").isEmpty()
        discard(known)
        known = grown
        if changed:
            discard(both)
            return known
