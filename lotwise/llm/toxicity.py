"""Toxicity by logistic regression, fitted with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of their first STEM bytes (inflected forms share these), of pairs
of neighbours, and of pairs one word apart. FTRL keeps a learning rate for each coordinate and an L1 term that leaves most
weights at exactly 0, so the model is a short table of (slot, weight), at most 2^bits rows, that is broadcast. The fit is
sequential by nature and runs in one task over a bounded sample of the labelled rows (`most`). What reaches that task is not
texts but each row's slots, and of these only the ones that LEAST_DOCS rows of the sample share. Scoring runs over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import discard, distinct_sample, materialise
from .words import BYTE, C2, U64, Words, mix, place, slices

ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0
BITS, EPOCHS = 22, 5
#: Bytes of a word that stand for its stem.
STEM = 5
#: A slot takes part once so many documents of the sample have it; what one document has teaches nothing about others.
LEAST_DOCS = 10
#: Toxic documents are the rarer kind: their errors weigh so much more.
TOXIC_WEIGHT = 3.0
#: Labelled documents that a fit uses at most.
MOST = 30_000


def stems(words: Words) -> np.ndarray:
    """The hash of the first STEM bytes of each word, A-Z like a-z."""
    if not len(words.start):
        return np.empty(0, U64)
    j = np.arange(STEM)
    at = np.minimum(words.start[:, None] + j, len(words.buf) - 1)
    return mix(np.where(j < words.length[:, None], BYTE[words.buf[at]] * place(STEM)[:STEM], U64(0)).sum(1, dtype=U64) + C2)


def slots(buf: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The distinct slots of each text: words, stems, neighbours, skip-grams with one word between."""
    words = Words(buf, offsets)
    stem = stems(words)
    for lo, hi in zip(words.bounds, words.bounds[1:], strict=False):
        h = words.hash[lo:hi]
        pair = mix(h[:-1] * U64(3) + h[1:] * U64(5)) if len(h) > 1 else h[:0]
        skip = mix(h[:-2] * U64(7) + h[2:] * U64(11)) if len(h) > 2 else h[:0]
        yield np.unique((np.concatenate([h, stem[lo:hi], pair, skip]) >> U64(64 - bits)).astype(np.int32))


def sigmoid(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal for binary features; the constant slot is kept apart and not shrunk."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, free = self.z[at], at == self.bias
        shrunk = np.where(free, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + np.where(free, 0, L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * (TOXIC_WEIGHT if label else 1.0)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(labelled: DataFrame, bits: int = BITS, epochs: int = EPOCHS, most: int = MOST) -> DataFrame:
    """labelled (doc_id, text, label 0/1) -> (slot, weight) of the weights that are not 0; the constant has slot 2^bits.

    Rows whose text or label is null teach nothing; rows that repeat doc_id and text count once. About `most` rows at most are
    used, chosen by the hash of doc_id and text. Without any row there are no weights.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0)):
                for own in slots(buf, offsets, bits):
                    having[own] += 1
        at = np.flatnonzero(having)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(having[part].astype(np.int64))], names=["slot", "n"])

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.zeros(1 << bits, bool)
        shared[frequent.value] = True
        for batch in batches:
            rows = [own[shared[own]] for _, _, buf, offsets in slices(batch.column(1)) for own in slots(buf, offsets, bits)]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), lists], names=["doc_id", "h", "label", "slots"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            flat, bounds = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            bounds = bounds - bounds[0]
            rows += [np.append(flat[lo:hi], np.int32(1 << bits)) for lo, hi in zip(bounds, bounds[1:], strict=False)]
            labels += batch.column(0).to_pylist()
        model = Ftrl(bits)
        order = np.random.default_rng(0)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                model.learn(rows[i], labels[i])
        at = np.flatnonzero(model.n)  # the slots that were learnt from, a small part of all
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0]), pa.array(w[w != 0])], names=["slot", "weight"])

    known = labelled.filter("label is not null and text is not null")
    chosen = distinct_sample(known, ["doc_id", "text"], most).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"), F.col("label").cast("int").alias("label"))
    chosen = materialise(chosen, "sample")
    counted = chosen.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    # At most 2^bits slots, whatever the texts are.
    frequent = labelled.sparkSession.sparkContext.broadcast(np.array([row.slot for row in counted.select("slot").toLocalIterator()], np.int32))
    rows = chosen.mapInArrow(slotted, "doc_id string, h long, label int, slots array<int>")
    out = materialise(rows.repartition(1).sortWithinPartitions("doc_id", "h").select("label", "slots").mapInArrow(train, "slot long, weight double"), "weights")
    discard(chosen)
    return out


def score(docs: DataFrame, weights: DataFrame, bits: int = BITS, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """docs with a column toxicity (0 to 1) of the column or field `text`. A null or empty text has the score of the constant alone.

    Rows that repeat are scored each; further columns stay, but for those in `without` (a text that isn't wanted back need not
    go to Python twice), and a column toxicity is replaced; long texts count whole; an empty table gives an empty table.
    """
    table = np.zeros((1 << bits) + 1)
    for row in weights.toLocalIterator():  # at most 2^bits + 1 short rows
        table[row.slot] = row.weight
    at = np.flatnonzero(table)
    model = docs.sparkSession.sparkContext.broadcast((at, table[at]))
    docs = docs.drop("toxicity")
    asked = docs.select("*", F.col(text).cast("binary").alias("__bytes")).drop(*without)
    own = asked.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = model.value
        table = np.zeros((1 << bits) + 1, np.float32)
        table[at] = w
        for batch in batches:
            out = []
            for _, _, buf, offsets in slices(batch.column(len(own))):
                out += [table[slot].sum(dtype=np.float64) + table[-1] for slot in slots(buf, offsets, bits)]
            columns = [batch.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sigmoid(np.array(out)))], names=[*own, "toxicity"])

    kinds = StructType([*asked.schema.fields[:-1], StructField("toxicity", DoubleType())])
    return asked.mapInArrow(run, kinds)


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of a bounded, repeatable choice of the labelled rows that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out).groupBy("doc_id").agg(F.max(label).alias("label"))
    few = distinct_sample(known, ["doc_id"], most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `most` rows


def score_with_labels(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, held_out: Column, most: int = MOST, without: tuple[str, ...] = ()) -> DataFrame:
    """docs with toxicity by a model fitted on train_docs and labels.toxic; held_out is a condition on doc_id.

    Null texts count as empty, rows that repeat are scored each, further columns stay, an empty table gives an empty table.
    Without any labelled row all scores are 0.5.
    """
    return score(docs, fit(labelled_documents(train_docs, labels, "toxic", held_out, most), most=most), without=without)
