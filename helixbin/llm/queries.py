"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.llm import bpe, centroids, conversations, licenses, lines, mixing, neardup, quality, substrings, topk, toxicity, urls, webp


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_read(spark, sf_dir, "documents"), ["doc_id"])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(_read(spark, sf_dir, "documents"))
    first = F.get("copies", F.lit(0))["position"].alias("first_position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("first_position", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.with_token_digests(_read(spark, sf_dir, "documents"), ["doc_id"], vocabulary)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(_read(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.col(f"q.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, "base_failed", "kept", "distance2")


def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.with_media(_read(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "m.*")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_read(spark, sf_dir, "pages"), ["page_id"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.judged(_read(spark, sf_dir, "documents"), ["doc_id"])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    models = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, ["doc_id"], models)
    return rows.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.judged(_read(spark, sf_dir, "documents"), ["doc_id"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.judged(_read(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda p: p.cast("string")), ",").alias("removed"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.judged(_read(spark, sf_dir, "conversations"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summarised(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_source_mix, op3_byte_bpe, op4_quality_rules, op5_lossless_webp, op6_url_filter, op7_substring_dedup,
        op8_toxicity, op9_near_duplicates, op10_line_dedup, op11_exact_topk, op12_conversation_repair, op13_ball_kmeans,
    )
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.sql(),
    "op2_source_mix": mixing.sql(),
    "op6_url_filter": urls.sql(),
    "op11_exact_topk": topk.sql(),
    "op12_conversation_repair": conversations.sql(),
    "op13_ball_kmeans": centroids.sql(),
}
