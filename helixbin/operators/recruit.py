"""Recruitment of short contigs into bins by their coverage percentiles."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbin.sources.store import materialize

log = logging.getLogger("helixbin")

#: Vectors of a block: a task compares two blocks at a time, so that neither side of a bin has to be in one task. A vector is sent
#: once for each block of the other side, so blocks are large: 8192 vectors of 100 percentiles are 6.5 MB.
BLOCK = 8192
#: Bounds are floating-point; one must be missed by more than this share of itself.
SLACK = 1e-9


def percentile_vectors(depths: DataFrame, percentiles: list[float] | None = None) -> DataFrame:
    """(contig, sample, pct): interpolated percentiles 0 to 99 of the depths (contig, sample, depth), zeros included."""
    p = percentiles if percentiles is not None else [i / 100 for i in range(100)]
    return depths.groupBy("contig", "sample").agg(F.percentile(F.col("depth").cast("double"), F.array(*map(F.lit, p))).alias("pct"))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def _rows(table: pa.Table) -> np.ndarray:
    column = table.column("pct").combine_chunks()
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


#: Rows that are compared at once, and the share of the lengths below which a square distance by products of matrices is computed from differences.
STRIPE, CLOSE = 256, 1e-3


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted sum of the distances of each row of x to the rows of y."""
    centre = y.mean(axis=0)
    u, v = x - centre, y - centre
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    if not (np.isfinite(uu).all() and np.isfinite(vv).all()):
        return np.array([(np.sqrt(np.square(y - row).sum(axis=1)) * weight).sum() for row in x])
    out = np.zeros(len(x))
    for lo in range(0, len(x), STRIPE):
        lengths = uu[lo : lo + STRIPE, None] + vv
        square = lengths - 2 * (u[lo : lo + STRIPE] @ v.T)
        i, j = np.nonzero(square <= CLOSE * lengths)
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            square[a, b] = np.square(x[lo + a] - y[b]).sum(axis=1)
        out[lo : lo + STRIPE] = np.sqrt(square) @ weight
    return out


def _weights(table: pa.Table) -> np.ndarray:
    return table.column("weight").to_numpy().astype(float)


def _between(schema: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Sum of a query's distances to a block of references, a row a query."""

    def run(key: tuple, queries: pa.Table, refs: pa.Table) -> pa.Table:
        if not len(queries) or not len(refs):
            return pa.table([pa.array([], t.type) for t in (queries.column("contig"), queries.column("bin"))] + [pa.array([], pa.int64()), pa.array([], pa.float64())], schema)
        weight = _weights(refs)
        total = _sums(_rows(queries), _rows(refs), weight)
        return pa.table([queries.column("contig"), queries.column("bin"), pa.array([int(weight.sum())] * len(total), pa.int64()), pa.array(total, pa.float64())], schema)

    return run


def _inside(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sum of the distances between two blocks of a bin and sample; of a block and itself every pair counts once."""
    total = 0.0  # a block can be empty
    if len(left) and len(right):
        total = float(_sums(_rows(left), _rows(right), _weights(right)) @ _weights(left))
    if key[2].as_py() == key[3].as_py():  # the two sides hold the same rows
        total /= 2
    return pa.table([pa.array([k.as_py()], k.type) for k in key[:2]] + [pa.array([total])], ["bin", "sample", "total"])


def _distinct(refs: DataFrame, *keys: str) -> DataFrame:
    """Equal vectors of a group as one, with their number and one of their names."""
    return refs.groupBy(*keys, "pct").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("weight"))


def _blocked(rows: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """Rows with a block of their group and the number of its blocks."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(f"{name}s"))
    return rows.join(sizes, keys).withColumn(name, F.pmod(F.xxhash64(by), f"{name}s"))


def within_bins(refs: DataFrame) -> DataFrame:
    """(bin, sample, intra): the mean distance of the pairs of references (bin, sample, ref, pct) of a bin."""
    kind = {f.name: f.dataType.simpleString() for f in refs.schema}
    dealt = materialize(_blocked(materialize(_distinct(refs, "bin", "sample")), ["bin", "sample"], "ref", "block"))
    keys = ["bin", "sample", "i", "j"]
    left = dealt.select("bin", "sample", "pct", "weight", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = dealt.toDF(*dealt.columns).select("bin", "sample", "pct", "weight", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_inside, f"bin {kind['bin']}, sample {kind['sample']}, total double")
    counts = refs.groupBy("bin", "sample").agg(F.count(F.lit(1)).alias("n"))
    mean = F.try_divide("total", F.col("n") * (F.col("n") - 1) / 2)
    return sums.groupBy("bin", "sample").agg(F.sum("total").alias("total")).join(counts, ["bin", "sample"]).select("bin", "sample", mean.alias("intra")).where("intra IS NOT NULL")


def _candidates(queries: DataFrame, centres: DataFrame, samples: list) -> DataFrame:
    """(contig, bin) that the pivot bound leaves in every sample, without a vector moved.

    A mean distance to references is at least the distance to their mean (norms are convex), and that is at least the
    difference of both distances to any pivot, here the origin. So a bin asks for queries whose norm lies within
    ``intra`` of its centre's: a join by intervals of the first sample's norm, then a look at the other samples' norms.
    """
    of = lambda rows, *more: F.map_from_entries(F.collect_list(F.struct("sample", F.struct(*more)))).alias("m")
    q = queries.select("contig", "sample", _norm("pct").alias("norm")).groupBy("contig").agg(of(queries, F.col("norm").alias("norm")))
    b = centres.select("bin", "sample", "intra", _norm("centre").alias("norm")).groupBy("bin").agg(of(centres, F.col("norm").alias("norm"), F.col("intra").alias("intra")))
    complete = lambda rows: rows.where(F.size("m") == len(samples))
    q, b = complete(q), materialize(complete(b))
    first = F.lit(samples[0])
    width = (b.agg(F.max(F.col("m")[first]["intra"])).first()[0] or 0.0) / 8 or 1.0
    reach = F.col("m")[first]["intra"] * (1 + SLACK) + SLACK
    lowest, highest = (F.floor((F.col("m")[first]["norm"] + s * reach) / width) for s in (-1, 1))
    bins = b.select("bin", F.col("m").alias("bm"), F.explode(F.sequence(lowest, highest)).alias("place"))
    each = q.select("contig", F.col("m").alias("qm"), F.floor(F.col("m")[first]["norm"] / width).alias("place")).join(bins, "place")
    far = lambda s: F.abs(F.col("qm")[s]["norm"] - F.col("bm")[s]["norm"]) > F.col("bm")[s]["intra"] * (1 + SLACK) + SLACK
    return each.where(~F.exists(F.array(*map(F.lit, samples)), far)).select("contig", "bin")


def recruits(vectors: DataFrame, bins: DataFrame, lengths: DataFrame, min_bin_size: int = 3, shorter: int = 2048, longer: int = 1024, computed: list[tuple[int, int]] | None = None) -> DataFrame:
    """(contig, bin, score): contigs with longer < length < shorter join the bin of least mean distance over the samples, the
    lower bin on ties, if in no sample they are farther from its contigs than those are from each other on average.

    Bounds leave few pairs of a contig and a bin; these are compared a sample at a time, and pairs that fail in one are not in the
    next. ``computed`` gets (distances computed, distances of all pairs) of each sample.
    """
    sized = bins.join(bins.groupBy("bin").count().where(F.col("count") >= min_bin_size).select("bin"), "bin", "left_semi")
    refs = materialize(sized.join(vectors, "contig").select("bin", "sample", F.col("contig").alias("ref"), "pct"))
    queries = materialize(lengths.where((F.col("length") > longer) & (F.col("length") < shorter)).select("contig").join(vectors, "contig").select("contig", "sample", "pct"))
    # queries of equal vectors in a sample are compared as one
    same = queries.groupBy("sample", "pct").agg(F.min("contig").alias("one"))
    queries = materialize(queries.join(same, ["sample", "pct"]).select("contig", "sample", "pct", "one"))
    samples = [r["sample"] for r in vectors.select("sample").distinct().orderBy("sample").collect()]  # as many as there are inputs
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *refs.schema]}
    width = refs.select(F.size("pct").alias("n")).first()
    if width is None or not samples:
        return queries.select("contig", F.lit(None).cast(kind["bin"]).alias("bin"), F.lit(0.0).alias("score")).where("false")
    mean = refs.groupBy("bin", "sample").agg(F.count(F.lit(1)).alias("size"), *(F.avg(F.get("pct", F.lit(i))).alias(f"c{i}") for i in range(width["n"])))
    mean = mean.select("bin", "sample", "size", F.array(*(F.col(f"c{i}") for i in range(width["n"]))).alias("centre"))
    centres = materialize(mean.join(within_bins(refs), ["bin", "sample"]))
    left = materialize(_candidates(queries, centres, samples).withColumn("score", F.lit(0.0)))
    for s in samples:
        q, c = (rows.where(F.col("sample") == F.lit(s)).drop("sample") for rows in (queries, centres))
        near = left.join(c, "bin").join(q, "contig").where(_distance("pct", "centre") <= F.col("intra") * (1 + SLACK) + SLACK)
        near = materialize(near.select("contig", "bin", "score", "intra", "one"))
        ref = materialize(_distinct(refs.where(F.col("sample") == F.lit(s)), "bin"))
        ref = materialize(_blocked(ref, ["bin"], "ref", "block"))
        ones = near.select("bin", F.col("one").alias("contig")).distinct().join(q.where("contig = one").select("contig", "pct"), "contig")
        ask = materialize(_blocked(materialize(ones), ["bin"], "contig", "query").join(ref.groupBy("bin").agg(F.max("blocks").alias("blocks")), "bin"))
        ref = materialize(ref.join(ask.groupBy("bin").agg(F.max("querys").alias("querys")), "bin"))
        keys = ["bin", "query", "block"]
        asks = ask.select("contig", "bin", "pct", "query", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        gives = ref.select("bin", "pct", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("querys") - 1)).alias("query"), "block")
        parts = asks.groupBy(*keys).cogroup(gives.groupBy(*keys)).applyInArrow(_between(["contig", "bin", "n", "total"]), f"contig {kind['contig']}, bin {kind['bin']}, n bigint, total double")
        dist = materialize(parts.groupBy("contig", "bin").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("dist")))
        done, every = dist.agg(F.sum("n")).first()[0] or 0, q.count() * (c.agg(F.sum("size")).first()[0] or 0)
        log.info("recruitment, sample %s: %d distances of %d", s, done, every)
        if computed is not None:
            computed.append((done, every))
        fits = near.join(dist.withColumnRenamed("contig", "one"), ["one", "bin"]).where("dist <= intra")
        left = materialize(fits.select("contig", "bin", (F.col("score") + F.col("dist")).alias("score")))
    best = left.groupBy("contig").agg(F.min(F.struct((F.col("score") / len(samples)).alias("score"), "bin")).alias("v"))
    return best.select("contig", "v.bin", "v.score")
