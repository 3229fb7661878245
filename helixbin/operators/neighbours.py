"""Approximate nearest neighbours of many centres: a graph of bounded degree, improved by joins of neighbours of neighbours.

A centre's best neighbours so far are its edges. In a round every centre is a meeting point of a bounded number of its
neighbours and of the centres that have it as one; any two of them that have not met there before are compared, and each keeps the
other if it is nearer than the last it has. The first graph comes from the same comparison inside short runs of centres in order of
random projections. Rounds end when few edges change. No distance is wrong; some neighbours may be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.operators.ranking import ranked
from helixbin.sources.store import materialize

#: Neighbours that a meeting point takes of each kind (new or known, its own or those that have it), and centres in a run of a projection.
SAMPLE, RUN = 16, 32
#: Projections of the first graph, most rounds, and the share of edges below whose change rounds end.
PROJECTIONS, ROUNDS, SETTLED = 4, 12, 0.002
#: Distances by products are floating-point; a bound must be missed by more than this share of the lengths.
SLACK = 1e-9


def _least(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, dist) of members that meet in a row and are not both known there, where a has no b of the last distance or nearer."""
    for batch in batches:
        lists = batch.column("members")
        values, offsets = lists.values, lists.offsets.to_numpy()
        ids, vectors = values.field("id"), values.field("vec")
        width = len(vectors[int(offsets[0])]) if offsets[-1] > offsets[0] else 0
        lo, hi = int(offsets[0]), int(offsets[-1])
        start = vectors.offsets.to_numpy()[lo : hi + 1]
        x = vectors.values.to_numpy(zero_copy_only=False)[start[0] : start[-1]].reshape(-1, width) if width else np.zeros((0, 0))
        fresh = values.field("fresh").to_numpy(zero_copy_only=False)[lo:hi]
        last = values.field("last").to_numpy()[lo:hi]
        left, right, found = [], [], []
        for s, e in zip(offsets - lo, offsets[1:] - lo):
            # products tell most pairs that are too far; the distances of the others are computed from differences
            y = x[s:e]
            lengths = (y * y).sum(1)
            lengths = lengths[:, None] + lengths
            keep = (fresh[s:e, None] | fresh[None, s:e]) & ~(lengths - 2 * (y @ y.T) > np.square(last[s:e, None]) * (1 + SLACK) + SLACK * lengths)
            np.fill_diagonal(keep, False)
            i, j = np.nonzero(keep)
            d = np.sqrt(((y[i] - y[j]) ** 2).sum(1))
            near = d <= last[s:e][i]
            left.append(i[near] + s + lo), right.append(j[near] + s + lo), found.append(d[near])
        a, b = (ids.take(pa.array(np.concatenate(k) if k else np.zeros(0, np.int64))) for k in (left, right))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate(found) if found else np.zeros(0))], ["a", "b", "dist"])


def _compared(members: DataFrame, centres: DataFrame, last: DataFrame | None, kind: str) -> DataFrame:
    """(a, b, dist) from (hub, id, fresh): a row of the worker's input is a hub with the vectors of its members, a bounded number."""
    rows = members.join(centres.select(F.col("contig").alias("id"), F.col("centre").alias("vec")), "id")
    if last is None:
        rows = rows.withColumn("last", F.lit(float("inf")))
    else:
        rows = rows.join(last, "id", "left").withColumn("last", F.coalesce("last", F.lit(float("inf"))))
    packed = rows.groupBy("hub").agg(F.collect_list(F.struct("id", "vec", "fresh", "last")).alias("members")).where(F.size("members") > 1)
    met = packed.select("members").mapInArrow(_met, f"a {kind}, b {kind}, dist double").where("a <> b")
    return met.groupBy("a", "b").agg(F.min("dist").alias("dist"))


def _first_graph(centres: DataFrame, degree: int, seed: int, kind: str) -> DataFrame:
    width = centres.select(F.size("centre").alias("n")).first()["n"]
    rng = np.random.default_rng(seed)
    members = None
    for t in range(PROJECTIONS):
        weights = F.array(*(F.lit(float(x)) for x in rng.normal(size=width)))
        at = F.aggregate(F.zip_with("centre", weights, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        line = ranked(centres.select("contig", F.struct(at.alias("at"), "contig").alias("key")), "key", "place")
        runs = line.select(F.concat_ws(".", F.lit(t), F.floor(F.col("place") / RUN)).alias("hub"), F.col("contig").alias("id"), F.lit(True).alias("fresh"))
        members = runs if members is None else members.unionByName(runs)
    return _least(_compared(members, centres, None, kind), ["a"], [F.col("dist"), F.col("b")], degree).withColumn("fresh", F.lit(True))


def neighbour_graph(centres: DataFrame, degree: int = 250, seed: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, dist): about the ``degree`` nearest other contigs of each, of (contig, centre)."""
    kind = centres.schema["contig"].dataType.simpleString()
    centres = materialize(centres.select("contig", F.transform("centre", lambda v: v.cast("double")).alias("centre")))
    if centres.isEmpty():
        return centres.select(F.col("contig").alias("a"), F.col("contig").alias("b"), F.lit(0.0).alias("dist"))
    edges = materialize(_first_graph(centres, degree, seed, kind))
    for r in range(rounds):
        draw = F.xxhash64("a", "b", F.lit(seed * 1000 + r))
        own = materialize(_least(edges.select("a", "b", "fresh"), ["a", "fresh"], [draw], SAMPLE))
        back = _least(own, ["b", "fresh"], [draw], SAMPLE)
        members = own.select(F.col("a").alias("hub"), F.col("b").alias("id"), "fresh").unionByName(back.select(F.col("b").alias("hub"), F.col("a").alias("id"), "fresh"))
        members = members.groupBy("hub", "id").agg(F.max("fresh").alias("fresh"))
        last = edges.groupBy(F.col("a").alias("id")).agg(F.when(F.count(F.lit(1)) >= degree, F.max("dist")).alias("last"))
        found = _compared(members, centres, last, kind).withColumns({"fresh": F.lit(True), "known": F.lit(False)})
        used = own.where("fresh").select("a", "b", F.lit(True).alias("used"))
        kept = edges.join(used, ["a", "b"], "left").select("a", "b", "dist", (F.col("fresh") & F.col("used").isNull()).alias("fresh"), F.lit(True).alias("known"))
        every = kept.unionByName(found).groupBy("a", "b").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"), F.max("known").alias("known"))
        edges = materialize(_least(every, ["a"], [F.col("dist"), F.col("b")], degree))
        counts = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("known")).alias("new"), F.count_if("fresh").alias("fresh")).first()
        edges = edges.drop("known")
        if counts["new"] <= SETTLED * counts["n"] and counts["fresh"] <= 2 * SETTLED * counts["n"]:
            break
    return edges.select("a", "b", "dist")


def near_pairs(centres: DataFrame, r: float, degree: int = 250, seed: int = 1) -> DataFrame:
    """As ``radius_pairs``, approximately: ordered pairs within r of each other, of the nearest of either side."""
    near = neighbour_graph(centres, degree, seed).where(F.col("dist") <= r)
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")).groupBy("a", "b").agg(F.min("dist").alias("dist"))
