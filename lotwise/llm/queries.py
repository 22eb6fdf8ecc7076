"""The opN_ queries by production parameters over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, jaccard, langid, linedup, lm, media, neardup, packing, quality, toxicity, trie, urlrules
from .shared import crc_of_id
from .sql import ORACLE_SQL  # noqa: F401

#: (verdict, host/path prefix); the longest that fits a url decides.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_of_id() % modulus == remainder, F.lit(False))


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), capacity=2048)


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stupid_backoff(read(spark, sf_dir, "documents"))


def op3_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(4, 2)).select("doc_id", "text", "lang"))
    out = langid.predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_digests(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = toxicity.labelled_documents(docs, read(spark, sf_dir, "labels"), "quality", held_out(4, 2), most=20_000)
    out = quality.score(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), quality.fit(known))
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    out = toxicity.score_with_labels(wanted, docs, read(spark, sf_dir, "labels"), held_out(5, 0), without=("text",))
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing, op2_stupid_backoff, op3_url_association_rules, op4_language_centroids, op5_minhash_near_dedup,
        op6_line_dedup_runs, op7_quality_gam, op8_template_decontamination, op9_media_columns, op10_ftrl_toxicity,
        op11_conversation_prefix_trie, op12_filter_interaction_audit, op13_ngram_jaccard_join,
    )
}
