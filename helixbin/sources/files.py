"""Files of the workflow: FASTA, SAM text and BAM, id lists, bins, and what stages report."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.sources import bam

#: FASTA suffixes, the CIGAR letters that consume reference and query, and the nucleotide codes.
FASTA_SUFFIXES = (".fa", ".fasta", ".fna")
REFERENCE, QUERY, ALIGNED = "MDN=X", "MIS=X", "MI=X"
NUCLEOTIDES = "ACGTURYSWKMBDHVN.-"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq): records start at a line that begins with ``>``; the name is the header's first word. A record is the unit
    that is split over, so files of any size are read in parallel."""
    if not str(path).endswith(FASTA_SUFFIXES):
        raise NotImplementedError(f"FASTA files end with {', '.join(FASTA_SUFFIXES)}")
    raw = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace(F.regexp_replace("value", r"^>", ""), r"\r", "")
    at = F.instr(record, "\n")
    header = F.when(at > 0, F.substring(record, F.lit(1), at - 1)).otherwise(record)
    seq = F.when(at > 0, F.regexp_replace(F.substring(record, at + 1, F.length(record)), r"\s", "")).otherwise("")
    return raw.where(F.trim("value") != "").select(F.regexp_extract(header, r"^\s*(\S*)", 1).alias("contig"), seq.alias("seq"))


def count_fasta(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def _cigar_length(letters: str):
    parts = F.regexp_extract_all(F.col("cigar"), F.lit(rf"(\d+)[{letters}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))


def read_sam(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    """(sample, contig, flag, mapq, ref_start, ref_end, tlen, qlen, qalen) of SAM text; spans are 0-based and half-open.
    A read without a sequence has the length that its CIGAR implies."""
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))  # noqa: E731  null in header lines, however filters are ordered
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    rows = rows.select(at(2).alias("contig"), at(1).cast("int").alias("flag"), at(4).cast("int").alias("mapq"), (at(3).cast("int") - 1).alias("ref_start"), at(8).cast("int").alias("tlen"), at(5).alias("cigar"), at(9).alias("q"))
    qlen = F.when(F.col("q") != "*", F.length("q")).otherwise(_cigar_length(QUERY))
    return rows.select(F.lit(sample).alias("sample"), "contig", "flag", "mapq", "ref_start", (F.col("ref_start") + _cigar_length(REFERENCE)).alias("ref_end"), "tlen", qlen.alias("qlen"), _cigar_length(ALIGNED).alias("qalen"))


def read_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SAM and BAM files (or folders of BAM files), numbered as samples in order."""
    parts = []
    for i, p in enumerate(paths):
        rows = bam.read_bam(spark, [p]).withColumn("sample", F.lit(i)) if bam.is_bam(p) else read_sam(spark, p, i)
        parts.append(rows)
    return functools.reduce(DataFrame.unionByName, parts)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("contig")).where("contig <> ''").distinct()


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=False, schema="contig string, bin long")


def check_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that must hold rows."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def write_fasta(contigs: DataFrame, path: str) -> None:
    contigs.select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def write_exclusions(rows: DataFrame, path: str) -> None:
    """(contig, reason, value) with a header, tab-separated."""
    rows.select("contig", "reason", "value").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_repeats(rows: DataFrame, lengths: DataFrame, path: str, max_size: int = 300) -> None:
    """contig, head span and tail span as start-end, tab-separated; places are counted inside the compared ends of max_size letters
    and the last one is part of the span."""
    own = rows.join(lengths.select("contig", "length"), "contig")
    before = F.greatest(F.col("length") - max_size, F.lit(0))
    span = lambda a, b: F.concat_ws("-", a.cast("string"), (b - 1).cast("string"))
    head = span(F.col("head_start"), F.col("head_end"))
    own.select("contig", head, span(F.col("tail_start") - before, F.col("tail_end") - before)).write.mode("overwrite").csv(path, sep="\t")


def check_alphabet(contigs: DataFrame) -> None:
    """Raises if a sequence has a character that is no nucleotide code or gap."""
    odd = contigs.where(F.upper("seq").rlike(f"[^{NUCLEOTIDES}]")).select("contig").orderBy("contig").head(3)
    if odd:
        raise ValueError(f"no nucleotide sequences: {', '.join(str(r['contig']) for r in odd)}")


def write_bins(bins: DataFrame, path: str) -> None:
    bins.select("contig", "bin").write.mode("overwrite").csv(path, header=False)


def write_recruits(rows: DataFrame, path: str) -> None:
    """Nothing is written if there are none."""
    if not rows.isEmpty():
        rows.select("contig", F.col("bin").alias("bin_id")).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
