"""Audit of how filters interact: every document is replayed through all orders of five filters.

A document's failures are five columns, found in one pass over its text. `replay` crosses the documents with the 120 orders
(a fixed set, broadcast), computes the first step of each order that a document fails, explodes the five steps and aggregates
conditions over them by (part, order, step). The exploded rows are summed in the task that makes them: what is shuffled is
one row a task, part, order and step, however many documents there are. What grows with the documents (first ids of texts,
labels) is joined by sorting; only the orders are broadcast.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, spread_join

#: The filters, each by its letter; bit k of a document's `failed` is the k-th.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at one text alone: few words, repeated words, capitals, markup characters."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of every row: failed has bit k set if the document fails the k-th filter.

    E, the last filter, fails a text that a row of a lesser doc_id has as well. A row of null doc_id has no lesser one and is
    no lesser one. A doc_id with several labels is good (toxic) if any of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(text)
    bits = sum((F.when(fails[c], 1 << k).otherwise(0) for k, c in enumerate("ABCD")), F.lit(0))
    part = F.coalesce("lang", F.lit("")).alias("part")
    same = (F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    own = materialise(docs.select("doc_id", part, *same, bits.alias("bits")), "flags")
    first = own.filter("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    own = spread_join(own, first, ["h1", "h2"], ["doc_id", "bits"], "left", merge=True)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = spread_join(own, known, ["doc_id"], ["h1", "bits"], "left", merge=True)
    failed = F.col("bits") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return own.select("part", failed.alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """(filter_order, bits): the 120 orders and the bit of the filter of each step."""
    return spark.createDataFrame([(o, [1 << LETTERS.index(c) for c in o]) for o in ORDERS], "filter_order string, bits array<int>")


def replay(flagged: DataFrame) -> DataFrame:
    """flagged (part, failed, good, toxic) -> counts of every part, order and step."""
    met = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession)))  # 120 rows
    first = F.lit(6)
    for step in range(5, 0, -1):
        first = F.when(F.col("failed").bitwiseAND(F.get("bits", F.lit(step - 1))) != 0, step).otherwise(first)
    steps = met.select("*", first.alias("first")).select("*", F.explode(F.lit([1, 2, 3, 4, 5])).alias("step"))
    bit = F.get("bits", F.col("step") - 1)
    here, fails = F.col("first") == F.col("step"), F.col("failed").bitwiseAND(bit) != 0
    conditions = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("failed") == bit,
        "good_lost": here & (F.col("good") == 1),
        "toxic_lost": here & (F.col("toxic") == 1),
    }
    return steps.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs (doc_id, text, lang), labels (doc_id, quality, toxic); further columns are ignored, whatever their names. One row for
    each part (a lang of docs; null counts as the empty string), each of the 120 orders and each step, zeros included. Null
    texts count as empty; rows that repeat count each, and of rows with one text only those of the least doc_id pass E (rows
    of null doc_id all do); texts count whole; without labels nothing is good or toxic; an empty docs gives an empty table.
    shapley: what the step's filter removes, summed over all orders.
    """
    counts = materialise(replay(flags(docs, labels)), "replayed")
    filter_ = F.substring("filter_order", F.col("step"), F.lit(1))
    credit = counts.groupBy("part", filter_.alias("_filter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("_filter", filter_).join(credit, ["part", "_filter"]).drop("_filter")
