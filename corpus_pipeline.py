"""The corpus pipeline: four filtering stages, each written as Parquet and reread, then packing into sequences."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import decontam, linedup, neardup, packing, toxicity
from lotwise.llm.queries import held_out, read
from lotwise.llm.shared import new_path, once, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more go; the model learns from labelled rows among docs that are not held out.

    Null and empty texts have the score of the model's constant. Rows that repeat go or stay together. Without labels all
    scores are 0.5, which says nothing, and all rows stay. A column named toxicity is left as it is.
    """
    small_batches(spark)
    rows = docs.select(F.struct("*").alias("row"))
    known = toxicity.labelled_documents(docs, read(spark, sf_dir, "labels"), "toxic", held_out(5, 0), toxicity.MOST)
    weights = toxicity.fit(known)
    if weights.isEmpty():
        return docs
    return toxicity.score(rows, weights, text="row.text").filter("toxicity < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; a document stays, if need be with an empty text."""
    return linedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least doc_id stays; texts without words and rows without doc_id all stay."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a passage of a benchmark item, by template or word for word, go; null and empty texts stay."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, placed in sequences of 2,048 tokens; a null or empty text is one piece of the end token."""
    small_batches(spark)
    return packing.pack_documents(docs, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaked), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over documents, each on the table that the one before it wrote.

    With a folder of the shared store, a stage's table lies there under a digest of sf_dir and the stage's name, and a run over
    the same input that was stopped goes on after the last stage that was written whole; without, every run has a new folder.
    An empty table gives an empty table.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{folder}/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}" if folder else new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = once(spark, partial(stage, spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt classifier and tokenisation are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None
