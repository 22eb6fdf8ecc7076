"""Document quality by a generalised additive model with pairwise interactions.

Features are binned; for each feature, in turn, a shallow tree over its bins is fitted to the gradient of the logistic loss
and added, shrunk, to the feature's lookup table (cyclic boosting). The pairs of features with the largest gain on the
residuals then get two-dimensional tables the same way. Scoring looks bins up and adds. The fit runs in one task over a
bounded sample of the labelled rows (`most`); features and scores are computed over all texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import distinct_sample
from .toxicity import sigmoid
from .words import Words, slices

FEATURES = (
    "log_words", "word_length", "upper", "digit", "mark", "symbol", "wide", "lines", "distinct", "same_as_last",
    "top_word", "capital", "stop", "short", "long_word", "same_as_before_last",
)
BINS, PAIR_BINS, PAIRS = 48, 12, 10


def _classes() -> np.ndarray:
    kind = np.zeros((6, 256))
    text = np.arange(256)
    kind[0] = (text >= 65) & (text <= 90)
    kind[1] = (text >= 48) & (text <= 57)
    kind[2] = np.isin(text, [ord(c) for c in ",;:.'\"-()?"])
    kind[3] = (text > 32) & (text < 127) & ~np.char.isalnum([chr(c) for c in range(256)]) & (kind[2] == 0)
    kind[4] = text >= 0xC0
    kind[5] = text == 10
    return kind


KIND = _classes()


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    words = Words(buf, offsets)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i in range(len(out)):
        part = buf[offsets[i] : offsets[i + 1]]
        lo, hi = words.bounds[i], words.bounds[i + 1]
        n = hi - lo
        if not n:
            continue
        by_byte = KIND @ np.bincount(part, minlength=256)
        h, length, start = words.hash[lo:hi], words.length[lo:hi], words.start[lo:hi]
        _, count = np.unique(h, return_counts=True)
        tail = buf[start + length - 1]
        out[i] = [
            np.log1p(n), length.mean(), *(by_byte[:5] / len(part)), by_byte[5] / n, len(count) / n, (h[1:] == h[:-1]).mean() if n > 1 else 0,
            count.max() / n, KIND[0][buf[start]].mean(), (tail == ord(".")).mean(), (length <= 3).mean(), (length >= 14).mean(),
            (h[2:] == h[:-2]).mean() if n > 2 else 0,
        ]
    return out


def _split(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values by bin of a tree of at most `leaves` leaves over ordered bins, from gradient and curvature by bin."""
    edges = [0, len(g)]
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    value = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = value(a, c) + value(c, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(c[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    return out


def fit_tables(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> dict:
    """Cut points and lookup tables. Without both labels the tables are zero and the constant is the smoothed rate."""
    rate_of = (y.sum() + 0.5) / (len(y) + 1)
    model = {"base": float(np.log(rate_of / (1 - rate_of))), "cuts": [], "pair_cuts": [], "tables": [], "pairs": []}
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model["cuts"] = [quantiles(v, BINS) for v in x.T]
    model["pair_cuts"] = [quantiles(v, PAIR_BINS) for v in x.T]
    at = [np.searchsorted(c, v, side="right") for c, v in zip(model["cuts"], x.T, strict=True)]
    coarse = [np.searchsorted(c, v, side="right") for c, v in zip(model["pair_cuts"], x.T, strict=True)]
    tables = [np.zeros(len(c) + 1) for c in model["cuts"]]
    f = np.full(len(y), model["base"])
    for _ in range(rounds):
        for k, b in enumerate(at):
            p = sigmoid(f)
            step = rate * _split(np.bincount(b, y - p, len(tables[k])), np.bincount(b, p * (1 - p), len(tables[k])))
            tables[k] += step
            f += step[b]
    p = sigmoid(f)
    gains = []
    for i, j in combinations(range(x.shape[1]), 2):
        cell = coarse[i] * PAIR_BINS + coarse[j]
        gains.append(((np.bincount(cell, y - p) ** 2 / (np.bincount(cell, p * (1 - p)) + 1)).sum(), i, j))
    chosen = sorted(gains, reverse=True)[:PAIRS]
    grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in chosen]
    for _ in range(rounds // 3):
        for grid, (_, i, j) in zip(grids, chosen, strict=True):
            p = sigmoid(f)
            cell = coarse[i] * PAIR_BINS + coarse[j]
            g = np.bincount(cell, y - p, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            h = np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
            # A tree of depth two: the better axis first, then the other within each half.
            cut = max(range(1, PAIR_BINS), key=lambda c: g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1))
            step = np.vstack([np.tile(_split(g[s].sum(0), h[s].sum(0), 2), (n, 1)) for s, n in ((slice(0, cut), cut), (slice(cut, None), PAIR_BINS - cut))])
            grid += rate * step
            f += rate * step[coarse[i], coarse[j]]
    model["tables"] = tables
    model["pairs"] = [(i, j, grid) for grid, (_, i, j) in zip(grids, chosen, strict=True)]
    return model


def add_up(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    for cuts, table, v in zip(model["cuts"], model["tables"], x.T, strict=False):
        f += table[np.searchsorted(cuts, v, side="right")]
    for i, j, grid in model["pairs"]:
        f += grid[np.searchsorted(model["pair_cuts"][i], x[:, i], side="right"), np.searchsorted(model["pair_cuts"][j], x[:, j], side="right")]
    return sigmoid(f)


def _plain(model: dict) -> str:
    return json.dumps(model, default=lambda v: v.tolist() if isinstance(v, np.ndarray) else float(v) if isinstance(v, np.floating) else int(v))


def fit(labelled: DataFrame, most: int = 20_000) -> dict:
    """labelled (doc_id, text, label 0/1) -> the lookup tables, a few thousand numbers.

    Rows whose text or label is null teach nothing; rows that repeat doc_id and text count once. About `most` rows at most are
    used, chosen by the hash of doc_id and text. Without rows of both labels every text gets the smoothed rate of label 1.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.vstack([np.empty((0, len(FEATURES))), *(features(buf, offsets) for _, _, buf, offsets in slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "x", "y"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            x += batch.column(1).to_pylist()
            y += batch.column(2).to_pylist()
        model = fit_tables(np.array(x).reshape(-1, len(FEATURES)), np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array([_plain(model)])], names=["model"])

    known = labelled.filter("label is not null and text is not null")
    chosen = distinct_sample(known, ["doc_id", "text"], most).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"))
    rows = chosen.mapInArrow(measure, "doc_id long, x array<double>, y int").repartition(1).sortWithinPartitions("doc_id", "x")
    found = rows.mapInArrow(train, "model string").first()
    model = json.loads(found.model if found else _plain(fit_tables(np.empty((0, len(FEATURES))), np.empty(0))))
    return {k: [np.array(v) for v in x] if k in ("cuts", "pair_cuts", "tables") else x for k, x in model.items()} | {"pairs": [(i, j, np.array(g)) for i, j, g in model["pairs"]]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a column quality_score (0 to 1); null and empty texts are scored by zero features.

    Rows that repeat are scored each; further columns stay, but a column quality_score is replaced; long texts count whole; an
    empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables: bounded by features and bins
    docs = docs.drop("quality_score")
    own = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.vstack([np.empty((0, len(FEATURES))), *(features(buf, offsets) for _, _, buf, offsets in slices(batch.column(len(own))))])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), pa.array(add_up(shared.value, x))], names=[*own, "quality_score"])

    kinds = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.select("*", F.col("text").cast("binary").alias("__bytes")).mapInArrow(run, kinds)
