"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing and tokenization of ``documents``.

Every stage takes (spark, docs, sf_dir), returns a DataFrame, and works on all that its predecessor kept; ``run`` writes each
stage's rows as Parquet to shared storage and reads them again. All but the last return the columns of documents.

Defined results of every stage: other columns pass through unchanged, whatever they are called; null and empty texts have no words, so
that the first stage drops them and the later ones, given such rows, keep (near-dedup, tokens), drop (line dedup) or never take (mix)
them; a null language or source is a group of its own and a null id sorts after all others; texts of any length are read whole; an empty
table gives an empty one. Repeated rows are judged alike by the first stage, are one document to line dedup, leave one row in
near-dedup, and have a share each in the mix. Ties go to the smaller id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.llm import bpe, lines, mixing, neardup, quality
from helixbin.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source; rows stay as they are."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; n_chars follows the text. Texts of which nothing is left go."""
    kept = lines.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id; its row stays as it is."""
    return neardup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in training order: a row for each copy of a document that the mix takes.

    The copy at the end of a source's demand is taken whole if at least half of its words are wanted, else left out. Rows that are equal
    in all columns are taken from one of them.
    """
    # a part a column, its length before it, so that different rows never give one string
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.sha2(F.concat(*map(part, columns)), 256).alias("key"), F.struct(*columns).alias("row"))  # no name of docs is left to clash
    plan = mixing.planned(rows.select(F.col("key").alias("doc_id"), "row.text", "row.source"))
    copies = plan.select("doc_id", "size", F.explode("copies").alias("c")).where(2 * F.col("c.words") >= F.col("size"))
    copies = copies.select(F.col("doc_id").alias("key"), F.col("c.position").alias("position"))
    # equal rows have a share each in the plan, so that one of them meets all their copies
    return rows.dropDuplicates(["key"]).join(copies, "key").orderBy("position", "row.doc_id").select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, of every row of the mix."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.with_token_digests(docs, ["doc_id", "source"], vocabulary)


STAGES = [
    ("4 quality rules", quality_rules),
    ("10 line dedup", line_dedup),
    ("9 near-duplicates", near_dedup),
    ("2 source mix", source_mix),
    ("3 byte-level BPE", tokenized),
]

#: Robust estimates, MinHash and BPE are beyond SQL; tests/llm holds the stages against brute force instead (the outlier verdict of the
#: first one only on planted outliers).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
