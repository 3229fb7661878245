"""Coverage kept up to date as alignment files arrive: an optional extra over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.operators import alignments as A

SCHEMA = "sample int, contig string, flag int, mapq int, ref_start int, ref_end int, tlen int, qlen int, qalen int"


def alignment_stream(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of the Parquet files in a folder, as they arrive."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def depth_stream(alignments: DataFrame, tests: list) -> DataFrame:
    """(contig, sample, pos, depth): running sums, for output mode update or complete."""
    spanned = A.spans(alignments.where(A.accepted(tests))).where("end > start")
    each = spanned.select("contig", "sample", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return each.groupBy("contig", "sample", "pos").agg(F.count(F.lit(1)).alias("depth"))
