"""Language identification by nearest centroid.

A text is the L2-normalised TF-IDF vector of its hashed byte n-grams (orders 1 to 3, A-Z folded); the document frequencies
are counted over all known texts. Each language has several centroids, from spherical k-means over a bounded sample of its
own distinct known texts (`most` a language), so that dialects or layouts of one language need not share a mean, and a rare
language is learnt as well as a common one. A text takes the language of the centroid of highest cosine; a text farther from it than
that centroid's own radius is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import distinct_sample
from .words import BYTE, U64, mix, slices, stream

SLOTS = 4096
#: Added to the logarithm: nearly every text has the common n-grams, and how often they come is what tells languages apart.
IDF_FLOOR = 3.0
NONE = "und"
#: Texts that are dense rows of SLOTS at one time.
ROWS = 128


def counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 + log of n-gram counts: one row of SLOTS for each text."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    value = BYTE[buf] + U64(1)  # all white space alike
    salt = stream(3, 21) | U64(1)
    out = np.zeros(n * SLOTS, np.int64)
    for order in (1, 2, 3):
        m = len(buf) - order + 1
        if m <= 0:
            break
        h = np.zeros(m, U64)
        for k in range(order):
            h += value[k : k + m] * salt[k]
        slot = (mix(h + U64(order)) >> U64(52)).astype(np.int64)
        same = row[:m] == row[order - 1 :]  # n-grams that don't leave their text
        out += np.bincount((row[:m] * SLOTS + slot)[same], minlength=n * SLOTS)
    return np.log1p(out.reshape(n, SLOTS))


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length, and the cosine that all but one in a hundred of their members reach."""
    first = [0]  # farthest-first start: repeatable
    near = x @ x[0]
    while len(first) < min(k, len(x)):
        first.append(int(near.argmin()))
        near = np.maximum(near, x @ x[first[-1]])
    c = x[first]
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        c = normalised(np.vstack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    close = x @ c.T
    own = close.argmax(1)
    return c, np.array([np.quantile(close[own == j, j], 0.01) if (own == j).any() else 1.0 for j in range(len(c))])


def _frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and how many texts there are: sums of a batch, added up in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0), 1 << 19, ROWS):
                held += (counts(buf, offsets) > 0).sum(0)
                n += len(offsets) - 1
        slot = np.append(np.flatnonzero(held), SLOTS)  # the last stands for all texts
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.append(held[slot[:-1]], n))], names=["slot", "n"])

    sums = known.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS + 1, np.int64)
    for r in sums:  # at most SLOTS + 1 short rows
        out[r.slot] = r.n
    return out[:-1], int(out[-1])


def fit(labelled: DataFrame, clusters: int = 4, most: int = 1000) -> dict:
    """labelled (doc_id, text, lang) -> {"langs", "idf", "centroids", "radius"}; at most clusters centroids a language.

    Rows whose text is null or empty, or whose lang is null, teach nothing; neither does doc_id. Texts that repeat within a
    language count once in its sample of about `most` texts, and each time in the document frequencies. Texts count whole.
    Without any known row the model has no language.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in slices(batch.column(0), 1 << 19, ROWS):
                x = counts(buf, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(lo, hi - lo)], names=["x", "lang"])

    known = labelled.filter("lang is not null and text is not null and text <> ''")
    held, n = _frequencies(known)
    idf = (np.log((1 + n) / (1 + held)) + IDF_FLOOR).astype(np.float32)

    def train(table: pa.Table) -> pa.Table:
        x = np.array([np.frombuffer(r.as_py(), np.float32) for r in table.column("x")], np.float32)
        c, radius = spherical_kmeans(normalised(x * idf), clusters)
        vectors = pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary())
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c), pa.string()), "v": vectors, "radius": pa.array(radius.astype(float))})

    chosen = distinct_sample(known, ["text"], most, ["lang"]).select(F.col("text").cast("binary").alias("text"), "lang")
    rows = chosen.mapInArrow(measure, "x binary, lang string").select("x", "lang", F.xxhash64("x").alias("h"))

    def train_sorted(table: pa.Table) -> pa.Table:
        return train(table.sort_by([("h", "ascending"), ("x", "ascending")]))  # whatever order the rows came in

    found = rows.groupBy("lang").applyInArrow(train_sorted, "lang string, v binary, radius double").orderBy("lang", "v").collect()  # clusters x languages short rows
    vectors = np.array([np.frombuffer(r.v, np.float32) for r in found])
    return {"langs": [r.lang for r in found], "idf": idf, "centroids": vectors, "radius": np.array([r.radius for r in found])}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learnt. Rows that repeat
    are judged each; further columns stay (columns of the three names are replaced); an empty table gives an empty table. Of
    two centroids at the same cosine the one of the first language by name decides.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x clusters x SLOTS
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, cosine = np.zeros(len(batch), int), np.zeros(len(batch))
            if m["langs"]:
                for lo, hi, buf, offsets in slices(batch.column(len(own)), 1 << 19, ROWS):
                    close = normalised(counts(buf, offsets).astype(np.float32) * m["idf"]) @ m["centroids"].T
                    best[lo:hi], cosine[lo:hi] = close.argmax(1), close.max(1)
            written = np.array(batch.column(len(own) + 1).to_pylist(), bool) & bool(m["langs"])
            langs = [m["langs"][b] if ok else NONE for b, ok in zip(best, written, strict=True)]
            cosine = np.where(written, np.clip(cosine, 0, 1), 0.0)
            far = ~written | (cosine < (m["radius"][best] if m["langs"] else 1))
            columns = [*(batch.column(k) for k in range(len(own))), pa.array(langs, pa.string()), pa.array(cosine), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "lang_pred", "lang_score", "lang_rejected"])

    learnt = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_rejected", BooleanType())]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    wide = docs.select("*", F.col("text").cast("binary").alias("__bytes"), letters.alias("__letters"))
    return wide.mapInArrow(run, StructType([*docs.schema.fields, *learnt]))
