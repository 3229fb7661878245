"""Neighbours in latent space and scoring of contig pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.operators import neighbours
from helixbin.operators.ranking import ranked
from helixbin.operators.selection import percentile
from helixbin.sources.store import materialize

#: Contigs from which neighbours within the radius come from an approximate graph of the nearest; below it, all are found.
EXACT_CONTIGS = 20_000
#: Nearest contigs that this graph keeps of each.
GRAPH_DEGREE = 1000


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(latent: DataFrame) -> DataFrame:
    """(contig, centre) from (contig, frag, vec): the mean over fragments."""
    each = latent.select("contig", F.posexplode("vec").alias("dim", "v"))
    mean = each.groupBy("contig", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("centre"))


def fragment_distances(latent: DataFrame, centres: DataFrame) -> DataFrame:
    vec = F.transform("vec", lambda x: x.cast("double"))
    return latent.join(centres, "contig").select("contig", "frag", F.sqrt(squared_distance(vec, F.col("centre"))).alias("dist"))


def radius(latent: DataFrame, centres: DataFrame) -> float:
    """90th percentile, interpolated, of the distances of all fragments to their contig's centre."""
    return percentile(fragment_distances(latent, centres), "dist", 0.9)


#: Centres of a block, of which a task compares two, and of a stripe of it that is compared at once.
BLOCK, STRIPE = 8192, 256
#: Distances by products of matrices are floating-point: pairs are looked at one by one where they could be off by this share of the lengths.
PRODUCT_SLACK = 1e-9


def _vectors(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _close(r: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Both orders of the pairs within r of two blocks; of a block and itself every pair is met twice."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        found_i, found_j, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            x, y = _vectors(left, "centre"), _vectors(right, "centre")
            xx, yy = (x * x).sum(1), (y * y).sum(1)
            for lo in range(0, len(x), STRIPE):
                part = x[lo : lo + STRIPE]
                lengths = xx[lo : lo + STRIPE, None] + yy
                i, j = np.nonzero(lengths - 2 * (part @ y.T) <= r * r + PRODUCT_SLACK * (lengths + r * r))
                for at in range(0, len(i), 1 << 14):
                    a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    total = np.zeros(len(a))
                    for d in range(x.shape[1]):  # in the order of the dimensions, as squared_distance
                        total += np.square(part[a, d] - y[b, d])
                    dist = np.sqrt(total)
                    near = dist <= r
                    found_i.append(lo + a[near]), found_j.append(b[near]), found.append(dist[near])
        i, j, dist = map(np.concatenate, (found_i, found_j, found))
        a, b = left.column("contig").take(pa.array(i)), right.column("contig").take(pa.array(j))
        if not same:
            a, b, dist = pa.chunked_array([*a.chunks, *b.chunks], a.type), pa.chunked_array([*b.chunks, *a.chunks], a.type), np.tile(dist, 2)
        return pa.table([a, b, pa.array(dist)], ["a", "b", "dist"])

    return run


def _block_pairs(centres: DataFrame, r: float, vectors: list[str]):
    """Rows (i, j, contig, *vectors) of two blocks at a time, cogrouped: all pairs of blocks that may hold centres within r of each other."""
    dims = centres.select(F.posexplode("centre").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("v")).orderBy("d").collect()  # one row a dimension
    pivot = F.array(*(F.lit(float(x["v"])) for x in dims))
    far = F.sqrt(squared_distance(F.col("centre"), pivot))
    rows = centres.select("contig", *vectors, F.struct(far.alias("far"), "contig").alias("key")).where("contig IS NOT NULL AND centre IS NOT NULL")
    placed = materialize(ranked(rows, "key", "place").select("contig", *vectors, F.col("key.far").alias("far"), F.floor(F.col("place") / BLOCK).alias("block")))
    spans = placed.groupBy("block").agg(F.min("far").alias("lo"), F.max("far").alias("hi"))  # a row a block
    one, two = spans.toDF("i", "lo", "hi"), spans.toDF("j", "lo_j", "hi_j")
    reach = r * (1 + 1e-9) + 1e-9
    pairs = materialize(one.join(F.broadcast(two), (F.col("i") <= F.col("j")) & (F.col("lo_j") <= F.col("hi") + F.lit(reach))).select("i", "j"))
    left = placed.withColumnRenamed("block", "i").join(F.broadcast(pairs), "i").select("i", "j", "contig", *vectors)
    right = placed.toDF("contig", *vectors, "far", "j").join(F.broadcast(pairs.toDF("i", "j")), "j").select("i", "j", "contig", *vectors)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def radius_pairs(centres: DataFrame, r: float) -> DataFrame:
    """(a, b, dist) of ordered pairs of different contigs within r, exact, without a cross join of rows.

    Centres within r of each other have distances to a fixed pivot, the mean of the centres, that differ by at most r. Centres are dealt to
    blocks of bounded size in order of that distance, and a task compares two blocks by products of matrices, if their distances to the
    pivot allow. In many dimensions that leaves most pairs of blocks: the job is quadratic, spread over the cluster and bounded in memory.
    """
    kind = centres.schema["contig"].dataType.simpleString()
    near = _block_pairs(centres, r, ["centre"]).applyInArrow(_close(r), f"a {kind}, b {kind}, dist double")
    return near.where("a <> b")


def _best(xs: list[np.ndarray], ys: list[np.ndarray], mine: np.ndarray, theirs: np.ndarray, radii: list[float], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, dist): the k nearest rows of ys of each row of xs by the first feature and then by number, of those within the radii in every feature."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    yy = [(y * y).sum(1) for y in ys]
    for lo in range(0, len(xs[0]), STRIPE):
        maybe = mine[lo : lo + STRIPE, None] != theirs
        sure, first, slack = maybe.copy(), None, None
        for x, y, lengths, r in zip(xs, ys, yy, radii):
            part = x[lo : lo + STRIPE]
            lengths = (part * part).sum(1)[:, None] + lengths
            square, off = lengths - 2 * (part @ y.T), PRODUCT_SLACK * (lengths + r * r)
            maybe &= square <= r * r + off
            sure &= square <= r * r - off
            if first is None:
                first, slack = square, off
        if len(theirs) > k:  # what is farther than k others is left out before its distance is computed
            most = np.partition(np.where(sure, first + slack, np.inf), k - 1, axis=1)[:, k - 1]
            maybe &= first - slack <= most[:, None]
        i, j = np.nonzero(maybe)
        dist = np.zeros(len(i))
        near = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            a, b = lo + i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            for f, (x, y, r) in enumerate(zip(xs, ys, radii)):
                total = np.zeros(len(a))
                for d in range(x.shape[1]):  # in the order of the dimensions, as squared_distance
                    total += np.square(x[a, d] - y[b, d])
                total = np.sqrt(total)
                near[at : at + (1 << 14)] &= total <= r
                if f == 0:
                    dist[at : at + (1 << 14)] = total
        i, j, dist = i[near], j[near], dist[near]
        order = np.lexsort((theirs[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((lo + i[keep], j[keep], dist[keep]))
    return tuple(map(np.concatenate, zip(*found)))


def _nearest_close(radii: list[float], k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The k nearest, within the radii, of each centre of two blocks in the other block; of a block and itself in that block."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("contig").combine_chunks(), right.column("contig").combine_chunks()
        parts = []
        if len(left) and len(right):
            sides = [[_vectors(t, c) for c in t.column_names if c.startswith("centre")] for t in (left, right)]
            number = np.unique(np.array(names[0].to_pylist() + names[1].to_pylist()), return_inverse=True)[1]  # in the order of the contigs
            number = number[: len(left)], number[len(left) :]
            for x, y in ((0, 1),) if key[0].as_py() == key[1].as_py() else ((0, 1), (1, 0)):
                i, j, dist = _best(sides[x], sides[y], number[x], number[y], radii, k)
                parts.append(pa.table([names[x].take(pa.array(i)), names[y].take(pa.array(j)), pa.array(dist)], ["a", "b", "dist"]))
        return pa.concat_tables(parts) if parts else pa.table([names[0].slice(0, 0), names[0].slice(0, 0), pa.array([], pa.float64())], ["a", "b", "dist"])

    return run


def nearest_common(features: list[DataFrame], radii: list[float], k: int) -> DataFrame:
    """(a, b, dist), with the k nearest of each a among the contigs that are within the radius in every feature, at the first one's distance.

    As ``radius_pairs`` and ``common_neighbours``, but no more than k rows of a centre leave a pair of blocks, however many are within the
    radius; ``nearest`` picks from these.
    """
    rows, vectors = features[0], ["centre"]
    for f, other in enumerate(features[1:]):
        vectors.append(f"centre{f}")
        rows = rows.join(other.select("contig", F.col("centre").alias(vectors[-1])), "contig")
    kind = rows.schema["contig"].dataType.simpleString()
    return _block_pairs(materialize(rows), radii[0], vectors).applyInArrow(_nearest_close(radii, k), f"a {kind}, b {kind}, dist double")


def near_centres(centres: DataFrame, r: float, exact_contigs: int = EXACT_CONTIGS, degree: int = GRAPH_DEGREE) -> DataFrame:
    """(a, b, dist) of contigs within r: all of them for fewer than ``exact_contigs`` contigs, else those in the graph of the nearest."""
    if centres.limit(exact_contigs).count() < exact_contigs:
        return radius_pairs(centres, r)
    return neighbours.near_pairs(centres, r, degree)


def common_neighbours(features: list[DataFrame]) -> DataFrame:
    """Pairs (a, b, dist) that are neighbours in every feature, at the first one's distance."""
    first, *rest = features
    for other in rest:
        first = first.join(other.select("a", "b"), ["a", "b"], "left_semi")
    return first


def nearest(pairs: DataFrame, k: int = 250, connected: DataFrame | None = None) -> DataFrame:
    """(a, b, dist, rank) of the k nearest of each a, without self pairs and connected ones (src, dst in either order)."""
    rows = pairs.where("a <> b")
    if connected is not None:
        both = connected.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(connected.select(F.col("dst").alias("a"), F.col("src").alias("b")))
        rows = rows.join(both.distinct(), ["a", "b"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).where(F.col("rank") <= k)


def candidate_pairs(features: list[DataFrame], k: int = 250, scale: float = 1.0, exact_contigs: int = EXACT_CONTIGS, degree: int = GRAPH_DEGREE) -> DataFrame:
    """Unordered candidate pairs (src, dst) of latents (one DataFrame a feature): within each feature's radius, nearest first."""
    near = []
    for latent in features:
        centres = materialize(centroids(latent))
        near.append(near_centres(centres, scale * radius(latent, centres), exact_contigs, degree))
    picked = nearest(common_neighbours(near), k)
    return picked.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def packed(latent: DataFrame) -> DataFrame:
    """(contig, vecs) with the fragments' vectors in order."""
    return latent.groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("frag", "vec"))), lambda x: x["vec"]).alias("vecs"))


def score_pairs(pairs: DataFrame, features: list[DataFrame], combine, vote: float | None = None) -> DataFrame:
    """(src, dst, weight): the sum over all fragment pairs of the probability, or of votes over a threshold.

    combine(lefts, rights) takes one array of rows a feature for either side and returns a probability a row. A row of the
    worker's input is a contig pair with both sides' latents; the fragment pairs exist only in numpy, a contig pair at a time.
    """
    rows = pairs
    for f, latent in enumerate(features):
        p = packed(latent)
        rows = rows.join(p.toDF("src", f"a{f}"), "src").join(p.toDF("dst", f"b{f}"), "dst")
    n = len(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            weights = []
            for row in frame.itertuples(index=False):
                lefts = [np.stack(getattr(row, f"a{f}")).astype(np.float32) for f in range(n)]
                rights = [np.stack(getattr(row, f"b{f}")).astype(np.float32) for f in range(n)]
                i, j = np.repeat(np.arange(len(lefts[0])), len(rights[0])), np.tile(np.arange(len(rights[0])), len(lefts[0]))
                p = combine([x[i] for x in lefts], [y[j] for y in rights])
                weights.append(float(np.sum(p if vote is None else p > vote, dtype=np.float64)))
            yield pd.DataFrame({"src": frame["src"], "dst": frame["dst"], "weight": weights})

    kind = pairs.schema["src"].dataType.simpleString()
    return rows.mapInPandas(run, f"src {kind}, dst {kind}, weight double")


def dense_relu(vec: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """relu(W x + b) as an array column."""
    def unit(row: list[float], b: float) -> Column:
        w = F.array(*map(F.lit, row))
        return F.greatest(F.aggregate(F.zip_with(vec, w, lambda x, y: x * y), F.lit(float(b)), lambda s, v: s + v), F.lit(0.0))

    return F.array(*(unit(r, b) for r, b in zip(weights, bias)))


def confusion(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(acc, fp, fn, loss): shares by prediction over 0.5, and binary cross-entropy with logarithms of at least -100."""
    hit = F.col(p) > 0.5
    clamp = lambda c: F.greatest(F.when(c > 0, F.log(c)).otherwise(-100.0), F.lit(-100.0))
    loss = -(F.col(y) * clamp(F.col(p)) + (1 - F.col(y)) * clamp(1 - F.col(p)))
    n = F.count(F.lit(1))
    return rows.agg((F.count_if(hit == (F.col(y) == 1)) / n).alias("acc"), (F.count_if(hit & (F.col(y) == 0)) / n).alias("fp"), (F.count_if(~hit & (F.col(y) == 1)) / n).alias("fn"), F.avg(loss).alias("loss"))
