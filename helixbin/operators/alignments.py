"""Alignments to coverage: read filters and their counters, depth, runs of depth, masks, prevalence, synchronisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicates(min_mapq: int = 30, min_coverage: float = 50, flag: int = 3596, tlen_range: tuple[int, int] | None = None) -> list[Column]:
    """Mapped, mapping quality, aligned share, flag mask, and template length."""
    lo, hi = tlen_range or (None, None)
    return [
        F.col("flag").bitwiseAND(4) == 0,
        F.col("mapq") >= min_mapq,
        F.col("qalen") / F.col("qlen") >= min_coverage / 100,
        F.col("flag").bitwiseAND(flag) == 0,
        F.lit(True) if tlen_range is None else F.abs("tlen").between(lo, hi),
    ]


def accepted(tests: list[Column], compat: bool = False) -> Column:
    """All predicates; with compat only the last three count, as mapping and quality are merely logged there."""
    return reduce(Column.__and__, tests[2:] if compat else tests)


def counters(alignments: DataFrame, keys: list[str], tests: list[Column]) -> DataFrame:
    """Total, non-secondary, and each predicate's count, and their fractions of the total (null for no reads)."""
    names = ["mapped", "quality", "aligned", "flagged", "template"]
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("flag").bitwiseAND(256) == 0).alias("primary")]
    out = alignments.groupBy(*keys).agg(*counts, *(F.count_if(t).alias(n) for n, t in zip(names, tests)))
    return out.select("*", *(F.round(F.try_divide(n, "total"), 6).alias(f"{n}_fraction") for n in ["primary", *names]))


def spans(alignments: DataFrame, compat: bool = False) -> DataFrame:
    """Covered span [start, end); compat shifts spans a base to the left and ignores reads that start at 0."""
    if not compat:
        return alignments.withColumn("start", F.col("ref_start")).withColumn("end", F.col("ref_end"))
    return alignments.where("ref_start > 0").withColumn("start", F.col("ref_start") - 1).withColumn("end", F.col("ref_end"))


def depth(spanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, depth) of covered positions; deletions count and mates both count."""
    each = spanned.where("end > start").select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return each.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("depth"))


def runs(spanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, depth) of maximal runs of equal depth over 0, by a sweep over starts and ends: two rows a read,
    summed by position before the window."""
    ends = spanned.where("end > start").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*keys).orderBy("start")
    swept = steps.select(*keys, "start", F.lead("start").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return swept.where("depth > 0")


def zero_filled(runs: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, depth ARRAY<INT>) with a value for every position of (keys, length), zeros included, from runs (keys, start, end, depth)
    that do not overlap. The array is put together from the runs and the gaps between them, so that its cost is its length."""
    packed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("depth").cast("int").alias("depth")))).alias("r"))
    rows = lengths.where("length > 0").join(packed, keys, "left")
    none = F.array().cast("array<struct<start:int,end:int,depth:int>>")
    inside = F.filter(F.coalesce(F.col("r").cast("array<struct<start:int,end:int,depth:int>>"), none), lambda x: (x["start"] < F.col("length")) & (x["end"] > 0))
    rows = rows.select(*keys, F.col("length").cast("int").alias("length"), inside.alias("r"))
    before = lambda i: F.when(i > 0, F.get(F.col("r"), i - 1)["end"]).otherwise(F.lit(0))
    zeros = lambda n: F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)))
    clipped = lambda x: F.array_repeat(x["depth"], F.least(x["end"], F.col("length")) - F.greatest(x["start"], F.lit(0)))
    each = F.transform("r", lambda x, i: F.concat(zeros(x["start"] - before(i)), clipped(x)))
    last = F.coalesce(F.get(F.col("r"), F.size("r") - 1)["end"], F.lit(0))
    return rows.select(*keys, F.concat(F.flatten(each), zeros(F.col("length") - last)).alias("depth"))


def valid_runs(contigs: DataFrame) -> DataFrame:
    """(contig, start, end, shift) of the maximal stretches of letters other than N: a position p there becomes p - shift once all N
    are dropped. A row a stretch, not a base."""
    pieces = contigs.select("contig", F.regexp_extract_all(F.upper("seq"), F.lit("N+|[^N]+"), F.lit(0)).alias("p"))
    # running lengths: of all pieces, and of those of N
    fold = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"), F.array().cast("array<struct<start:int,end:int,shift:int>>").alias("out")), _advance, lambda s: s["out"])
    return pieces.select("contig", F.explode(fold).alias("r")).select("contig", "r.*")


def _advance(state: Column, piece: Column) -> Column:
    n, gap = F.length(piece), F.startswith(piece, F.lit("N"))
    end = state["at"] + n
    here = F.struct(state["at"].alias("start"), end.alias("end"), state["gone"].alias("shift"))
    return F.struct(end.alias("at"), (state["gone"] + F.when(gap, n).otherwise(0)).alias("gone"), F.when(gap, state["out"]).otherwise(F.concat(state["out"], F.array(here))).alias("out"))


#: Bases of a bin in which runs meet the valid stretches of their contig.
BIN = 4096


def masked_runs(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Runs (contig, ..., start, end, depth) cut to the valid letters of contigs, re-indexed as if all N were dropped. Runs and
    stretches meet by bins of positions, each pair in the first bin that they share."""
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BIN), F.floor((F.col(hi) - 1) / BIN)))
    valid = valid_runs(contigs).toDF("contig", "_lo", "_hi", "_shift").withColumn("_bin", bins("_lo", "_hi"))
    both = runs.where("end > start").withColumn("_bin", bins("start", "end")).join(valid, ["contig", "_bin"])
    first = F.col("_bin") == F.floor(F.greatest("start", "_lo") / BIN)
    both = both.where(first & (F.col("start") < F.col("_hi")) & (F.col("end") > F.col("_lo")))
    cut = both.withColumn("start", F.greatest("start", "_lo") - F.col("_shift")).withColumn("end", F.least("end", "_hi") - F.col("_shift"))
    return cut.drop("_lo", "_hi", "_shift", "_bin")


def valid_positions(contigs: DataFrame) -> DataFrame:
    """(contig, pos, new_pos) of letters other than N: the position, and the position once all N are dropped."""
    return valid_runs(contigs).select("contig", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "shift").select("contig", "pos", (F.col("pos") - F.col("shift")).alias("new_pos"))


def masked(coverage: DataFrame, contigs: DataFrame) -> DataFrame:
    """Coverage (contig, pos, ...) of the valid positions of contigs, re-indexed."""
    return coverage.join(valid_positions(contigs), ["contig", "pos"]).withColumn("pos", F.col("new_pos")).drop("new_pos")


def totals(runs: DataFrame) -> DataFrame:
    """(contig, sample, depth): the summed depth of runs (contig, sample, start, end, depth)."""
    return runs.groupBy("contig", "sample").agg(F.sum((F.col("end") - F.col("start")) * F.col("depth")).alias("depth"))


def prevalence(depths: DataFrame, lengths: DataFrame, min_prevalence: int = 2, noise: float = 0.1) -> DataFrame:
    """(contig, prevalence, kept): samples whose mean depth over the whole length, zeros included, exceeds the noise.
    depths (contig, sample, depth) has a row a position, or any partial sums of these."""
    sums = depths.groupBy("contig", "sample").agg(F.sum("depth").alias("total")).join(lengths, "contig")
    per = sums.groupBy("contig").agg(F.count_if(F.col("total") / F.col("length") > noise).alias("n"))
    out = lengths.select("contig").join(per, "contig", "left").select("contig", F.coalesce("n", F.lit(0)).cast("long").alias("prevalence"))
    return out.withColumn("kept", F.col("prevalence") >= min_prevalence)


def exclusions(depths: DataFrame, lengths: DataFrame, samples: list, min_prevalence: int = 2, noise: float = 0.1) -> DataFrame:
    """(contig, reason, value) of the rows that prevalence rejects; the value lists the means of all samples, in their order and to one
    decimal, those without a read as 0.0."""
    gone = prevalence(depths, lengths, min_prevalence, noise).where("NOT kept").select("contig")
    means = depths.groupBy("contig", "sample").agg(F.sum("depth").alias("t")).join(lengths, "contig").select("contig", F.struct("sample", F.round(F.col("t") / F.col("length"), 1).alias("m")).alias("m"))
    listed = means.groupBy("contig").agg(F.map_from_entries(F.collect_list("m")).alias("l"))
    value = lambda s: F.coalesce(F.try_element_at("l", s), F.lit(0.0)).cast("double").cast("string")
    text = F.array_join(F.transform(F.array(*map(F.lit, samples)), value), ",")
    return gone.join(listed, "contig", "left").select("contig", F.lit("prevalence").alias("reason"), text.alias("value"))


def by_length(contigs: DataFrame, min_length: int) -> DataFrame:
    """(contig, seq, length, kept) after cleaning; rows of min_length or more are kept."""
    from helixbin.functions.sequence import clean

    out = contigs.withColumn("seq", clean(F.col("seq"))).withColumn("length", F.length("seq"))
    return out.withColumn("kept", F.col("length") >= min_length)


def synchronized(left: DataFrame, right: DataFrame, key: str = "contig") -> DataFrame:
    """(key, side): both, left or right, by where the key stands."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.join(b, key, "left_semi").withColumn("side", F.lit("both"))
    return both.unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("left"))).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def without_ids(df: DataFrame, ids: DataFrame, key: str = "contig") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")
