"""Language-model scores by stupid backoff over n-gram counts of the whole corpus, computed by joins.

    S_1(w)           = c(w) / N
    S_k(w | context) = c(context w) / c(context)    if c(context w) >= min_count
                     = alpha * S_{k-1}(w | shorter context)    otherwise

A word is scored with the longest context that its text has before it, up to order - 1 words. Words are runs outside
[\\x20\\x09-\\x0D], A-Z folded; n-grams go by 64-bit hashes (among a billion distinct n-grams two clash in one corpus of about
forty; the counts of such a pair add up).

Documents are dealt by hash into blocks of bounded size: an n-gram is counted in its block before anything is shuffled by it,
so a frequent one costs one entry a block, however many documents have it, and no key is hot. A block sends its n-grams and
counts as arrays, one for each range of the hashes; there they are exploded into rows (block, gram, n) and summed over the
blocks, and the totals go back as arrays in the order in which they were sent. In the blocks they meet the words again, and
the logs are summed per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .words import C1, U64, Words, grams, mix, slices

#: Text of a block; ranges of the hashes for each partition of the counts.
BLOCK_BYTES, BUCKETS = 10 << 20, 4


def word_hashes(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and the texts' bounds in words."""
    found, sizes = [np.empty(0, U64)], [np.zeros(1, np.int64)]
    for _, _, buf, offsets in slices(text.combine_chunks()):
        words = Words(buf, offsets)
        found.append(words.hash)
        sizes.append(np.diff(words.bounds))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def exploded(words: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that end at each word; 0 where the text has not as many."""
    keys = np.zeros(len(words), U64)
    keys[n - 1 :] = np.maximum(mix(words ^ C1) if n == 1 else grams(words, n, seed=200 + n), U64(1))
    for k in range(n - 1):  # the first words of a text
        starts = bounds[:-1] + k
        keys[starts[starts < bounds[1:]]] = 0
    return keys


def block_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block's texts, in order of their hashes, and how often each occurs."""
    return np.unique(keys[keys > 0], return_counts=True)


def stupid_backoff(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, order: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoff, lm_score of every row; lm_score is the mean natural log of S over the row's words.

    n_backoff: words scored with fewer words of context than they have. Null and empty texts have no words and a null score.
    Rows that repeat count and are scored each; null doc_ids stay null; further columns are ignored; long texts count whole; an
    empty table gives an empty table.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
    buckets = BUCKETS * partitions
    starts_of_buckets = np.array([(b << 64) // buckets for b in range(buckets)], U64)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    blocked = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(partitions, "block")

    def count(table: pa.Table) -> pa.Table:
        words, bounds = word_hashes(table.column("text"))
        block, parts = table.column("block")[0].as_py(), []
        for k in range(1, order + 1):
            keys, n = block_counts(exploded(words, bounds, k))
            cuts = np.searchsorted(keys, starts_of_buckets)
            held = np.flatnonzero(np.diff(np.append(cuts, len(keys))))  # buckets in which the block has n-grams
            offsets = pa.array(np.append(cuts[held], len(keys)).astype(np.int32))
            lists = {"grams": pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64))), "ns": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))}
            parts.append(pa.table({"block": np.full(len(held), block, np.int64), "size": np.full(len(held), k, np.int32), "bucket": held.astype(np.int32)} | lists))
        return pa.concat_tables(parts)

    # A block sends the n-grams of a bucket (a range of the hashes) as one row, in their order, and gets their totals back in
    # the same order, so that these need no names. The buckets' partitions count them as plain rows.
    held = blocked.groupBy("block").applyInArrow(count, "block long, size int, bucket int, grams array<long>, ns array<long>").repartition(partitions, "bucket")
    rows = held.select("block", "size", "bucket", F.posexplode(F.arrays_zip("grams", "ns"))).select("block", "size", "bucket", F.col("pos").alias("at"), F.col("col.grams").alias("gram"), F.col("col.ns").alias("n"))
    # A partition's share of the n-grams is bounded, as there are more partitions with more input; one n-gram has a row a block.
    summed = rows.withColumn("total", F.sum("n").over(Window.partitionBy("bucket", "size", "gram")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda x: x["total"])
    totals = summed.groupBy("bucket", "block", "size").agg(in_order.alias("totals")).select("block", "size", "bucket", "totals")

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        words, bounds = word_hashes(table.column("text"))
        told_size, told_bucket, told_totals = told.column("size").to_numpy(), told.column("bucket").to_numpy(), told.column("totals").combine_chunks()
        size, before = len(words), None
        log, lost, single = np.zeros(size), np.zeros(size), np.ones(size, bool)
        for k in range(1, order + 1):
            keys = exploded(words, bounds, k)
            own = np.unique(keys[keys > 0])
            of_size = np.flatnonzero(told_size == k)
            n = told_totals.take(pa.array(of_size[np.argsort(told_bucket[of_size])])).flatten().to_numpy()  # all of the block's n-grams, in the order of their hashes
            count_of = n[np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))] * (keys > 0) if len(own) else np.zeros(size, np.int64)
            if k == 1:
                log = np.log(np.maximum(count_of, 1))
            else:
                seen = (keys > 0) & (count_of >= min_count)
                context = np.concatenate(([1], before[:-1])) if size else before
                log = np.where(seen, np.log(np.maximum(count_of, 1) / np.maximum(context, 1)), log)
                lost = np.where(seen, 0, lost + (keys > 0))
                single &= ~seen
            before = count_of
        per_doc = lambda x: np.add.reduceat(np.append(x, 0), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.empty(0)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(np.diff(bounds), pa.int64()),
                "n_single": pa.array(per_doc(single).astype(np.int64), pa.int64()),
                "n_backoff": pa.array(per_doc(lost > 0).astype(np.int64), pa.int64()),
                "logs": pa.array(per_doc(log + lost * math.log(alpha)), pa.float64()),
            }
        )

    scored = blocked.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_single long, n_backoff long, logs double")
    scored = materialise(scored, "scored")
    words = scored.agg(F.sum("n_words").alias("all"))  # one row
    mean = (F.col("logs") - F.col("n_single") * F.ln("all")) / F.col("n_words")
    return scored.crossJoin(F.broadcast(words)).select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, F.round(mean, 6)).alias("lm_score"))
