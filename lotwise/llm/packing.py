"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A task packs one block of pieces: pieces come by decreasing length, and each goes to the residual gap (or a new bin) after
which the sum over gaps of (open bins with that gap) squared is least; ties go to the smaller gap. Bins that a block leaves
with a gap are taken apart again, and their pieces are dealt into fewer blocks, round by round, until one block is left or
ROUNDS are over, so no task ever holds more than one bounded block. Each round is the same at every size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

#: Pieces that one task packs.
BLOCK = 50_000
#: Bins with a gap of at most capacity / SETTLED are not taken apart.
SETTLED = 512
#: Times that bins with a gap are taken apart.
ROUNDS = 6
#: Texts of these characters alone give the same ids in both libraries, whatever their Unicode tables; others take the slower one.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, salt long"
PLACED = "sequence long, offset long, gap long"


def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """text -> numpy array of the ids that `tokenizers` gives with the vocabulary at json_path, special tokens in the text included.

    ranks_path holds the same vocabulary as ranks, for a library that is faster by a factor of about four: it takes the texts
    that hold no special token and only PLAIN characters, for which both give the same ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(t in text for t in special):
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenised_pieces(docs: DataFrame, capacity: int, end_id: int = 0, with_ids: bool = False, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Each document's ids, then end_id, as pieces of at most `capacity`; of a longer one only the first piece is shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(json_path, ranks_path), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[lo:hi].astype("<u4")
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None, salt))
                salt += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in their order: bin, offset in it, and the gap that its bin has in the end."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, left = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    gaps = np.arange(capacity + 1)
    for i, s in enumerate(sizes.tolist()):
        usable = gaps[s:][count[s:] > 0]
        # (c+1)^2 - c^2 where the bin comes to, (c-1)^2 - c^2 where it leaves; a full bin counts no more
        best, gap = (2 * count[capacity - s] + 1 if s < capacity else 0), -1
        if len(usable):
            change = np.where(usable > s, 2 * count[usable - s] + 2, 1) - 2 * count[usable]
            k = int(change.argmin())
            if change[k] <= best:
                gap = int(usable[k])
        if gap < 0:
            gap, which = capacity, len(left)
            left.append(capacity)
        else:
            which = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i], left[which] = which, capacity - gap, gap - s
        if gap > s:
            open_bins[gap - s].append(which)
            count[gap - s] += 1
    return bins, offsets, np.array(left, np.int64)[bins] if len(sizes) else bins


def _packed(pieces: DataFrame, capacity: int, round_: int, blocks: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        table = table.take(order)
        bins, offsets, gaps = sum_of_squares(table.column("length").to_numpy(), capacity)
        block = table.column("block")[0].as_py()
        sequence = bins + ((round_ << 56) | (block << 28))
        table = table.select([x.split()[0] for x in PIECES.split(", ")])
        return table.append_column("sequence", pa.array(sequence)).append_column("offset", pa.array(offsets)).append_column("gap", pa.array(gaps))

    block = F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(round_)), F.lit(blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInArrow(pack, f"{PIECES}, {PLACED}")


def pack_documents(docs: DataFrame, capacity: int = 2048, with_ids: bool = False, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece of every row.

    A null or empty text is one piece of end_id alone. Rows that repeat a doc_id are packed each; a null doc_id stays null. A
    text of more than `capacity` ids is cut whole into pieces. Of two gaps that are equally good the smaller is taken.
    Further columns are ignored, whatever their names; an empty table gives an empty table.
    """
    rest = materialise(tokenised_pieces(docs, capacity, end_id, with_ids, json_path, ranks_path), "pieces")
    done, round_, n = [], 0, rest.count()
    while True:
        blocks, last = max(1, -(-n // BLOCK)), rest
        now = materialise(_packed(rest, capacity, round_, blocks), "packed")
        discard(last)
        round_ += 1
        if blocks == 1 or round_ == ROUNDS:
            done.append(now)
            break
        open_bins = f"gap > {capacity // SETTLED}"
        rest = materialise(now.filter(open_bins).drop("sequence", "offset", "gap"), "open")
        done.append(now.filter(f"not {open_bins}"))
        n = rest.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))
