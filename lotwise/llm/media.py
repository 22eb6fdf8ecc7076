"""Media columns: payloads stored as images in archives, and a Spark data source that reads archives by byte range.

Payload bytes are the samples of an 8-bit greyscale PNG, WIDTH samples a row (lossless, and compressed). Each task writes
one ZIP archive of such members to the shared folder. The data source `media_archive` plans byte ranges over the archives of
a folder from their sizes alone; a task reads its archive's directory and takes the members whose header starts in its
range. Every member is read by its own offset, checked against its CRC, and read again on failure, whatever happens to the
others; payloads stream out in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import new_path

WIDTH = 64
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
#: Bytes of a ZIP archive without members, as a task without rows leaves it.
NO_MEMBERS = 22
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "member string, doc_id long, n_bytes long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of WIDTH columns; the payload's length must be a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # each row after its filter type, 0
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw, 4)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png wrote."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if form != [8, 0, 0, 0, 0] or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit greyscale rows are read")
    return rows[:, 1:].tobytes()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(docs: DataFrame, folder: str) -> int:
    """Every row's text as a member of a ZIP archive under folder; gives the number of members.

    A task writes under a name of its own attempt and renames it to its partition's name in the end, so a task that runs
    twice leaves one archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = _store(folder)
        task = TaskContext.get()
        final, own = f"{path}/part-{task.partitionId():06d}.zip", f"{path}/_attempt-{task.taskAttemptId()}"
        store.create_dir(path, recursive=True)
        n = 0
        with store.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in batches:
                for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = data.as_py()
                    name = f"{n:09d}_{'' if doc_id is None else doc_id}_{len(data)}.png"
                    archive.writestr(name, encode_png(data + bytes(WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)))
                    n += 1
        if store.get_file_info(final).is_file:  # an earlier attempt of this task wrote the same
            store.delete_file(own)
        else:
            store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", payload.alias("data")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class Span(InputPartition):
    """The members of one archive whose headers start in [begin, end)."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, span: int, batch: int):
        self.folder, self.span, self.batch = folder, span, batch

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        store, path = _store(self.folder)
        files = [f for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".zip") and f.size > NO_MEMBERS]
        spans = [Span(f.path, at, at + self.span) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.span)]
        return spans or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        store, _ = _store(self.folder)
        names = [x.split()[0] for x in MEMBERS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0
        with store.open_input_file(span.path) as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if not span.begin <= info.header_offset < span.end:
                    continue
                data, error = self._member(store, span.path, archive, info)
                _, doc_id, size = info.filename.removesuffix(".png").split("_")
                rows.append((f"{span.path}#{info.header_offset}", int(doc_id) if doc_id else None, int(size), data, error))
                held += len(data or b"")
                if held >= self.batch:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    @staticmethod
    def _member(store, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member's bytes, or what went wrong in the last of TRIES tries; later tries open the archive anew at its offset."""
        error = None
        for k in range(TRIES):
            try:
                if k == 0:
                    return archive.read(info), None
                with store.open_input_file(path) as again, zipfile.ZipFile(again) as fresh:
                    return fresh.read(info), None
            except (OSError, EOFError, RuntimeError, struct.error, zipfile.BadZipFile, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


class MediaArchive(DataSource):
    """Format media_archive; options path, rangeBytes, batchBytes. A member that can't be read is a row with error set."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), int(self.options.get("batchBytes", BATCH_BYTES)))


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).load(folder)


def describe(samples: np.ndarray) -> str:
    """Height, mean, deviation, entropy in bits, and the mean difference between neighbours, of an image's samples."""
    n = np.bincount(samples, minlength=256)
    p = n[n > 0] / len(samples)
    step = np.abs(np.diff(samples.astype(np.int16)))
    return f"h={len(samples) // WIDTH};mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step.mean():.4f}"


def media_features(members: DataFrame) -> DataFrame:
    """The digests and the feature of every member, from the bytes read back. A member that can't be read or decoded has nulls, and its error says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, errors = [], batch.column(4).to_pylist()
            for i, media in enumerate(batch.column(3)):
                media = media.as_py()
                try:
                    payload = None if media is None else decode_png(media)
                except (ValueError, UnboundLocalError, struct.error, zlib.error) as e:  # one bad image doesn't stop the others
                    payload, errors[i] = None, f"{type(e).__name__}: {e}"
                if payload is None:
                    rows.append((None,) * 6)
                    continue
                rows.append((len(payload), sha(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha(media), describe(np.frombuffer(payload, np.uint8))))
            columns = [batch.column(1), batch.column(2), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", *names, "error"])

    return members.select("member", "doc_id", "n_bytes", "media", "error").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs (doc_id, text) through archives in the shared folder and back, one row for each row.

    A null text is empty; an empty text is one row of zero samples. Repeated rows and null doc_ids are members of their own;
    further columns are ignored; a text of any length is one member, held whole by one task; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    write_archives(docs, folder)
    return media_features(read_archives(spark, folder))
