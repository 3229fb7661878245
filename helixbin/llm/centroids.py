"""Centroid clustering: ball k-means over integer vectors.

A cluster is a ball: its centre and, in every batch of vectors, the radius of the members there. When centres have moved, another
centre can win a member only if it is nearer to the own centre than twice the radius: the neighbour centres. Members nearer to
their centre than half the distance of the nearest neighbour are the stable core and stay unseen. The rest lie in annuli:
between half the distances of the a-th and the next neighbour only the first a neighbours are compared. The
first assignment, before which there are no balls, compares all centres. Squares of integers are compared, so that
ties are exact: a member at exactly half the distance is compared, as a centre of smaller number can win a tie.

The centres (k times the width) are all that passes through the driver. Every round writes the vectors' clusters as a table in
shared storage; sums of a round are partial in each batch before they are shuffled.

Defined results: vectors that are null, are not of the width, or hold a null or a non-finite component take no part, and neither do
those with a scaled component from 2**20 on, whose distances the exact arithmetic cannot hold. With fewer than k vectors, each is
a centre. Rows of the same id have the same hash and are taken as centres in order of their components; null ids come last.
An inertia beyond a long is null. An empty table gives an empty result. Only the two named columns are read, so that
others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbin.llm.common import materialize, sums_between

#: Scaled components stay below this, so that squared distances stay exact in a double.
LARGEST = float(1 << 20)
KEPT = "vec_id long, packed binary"
ASSIGNED = "vec_id long, packed binary, cluster int, distance long"


def _scaler(width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scale_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            lists = vectors.cast(pa.large_list(pa.float64()))
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values * scale)
                bad = ~(np.abs(scaled) < LARGEST)
            good = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width) & (sums_between(bad, offsets) == 0)
            packed = np.where(bad, 0, scaled).astype("<i4")
            rows = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.int64()), pa.array([packed[offsets[i] : offsets[i] + width].tobytes() for i in rows], pa.binary())], ["vec_id", "packed"])

    return scale_batches


def _unpacked(packed: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(len(packed), width).astype(np.float64)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, exact: all sums stay below 2**53."""
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2) if len(x) * len(centres) * x.shape[1] < 1 << 16 else (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)


def moved_members(x: np.ndarray, cluster: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centre, squared distance) of vectors that belonged to ``cluster`` before the centres moved, and the number of
    distances to other centres that were computed. Ties go to the smaller number."""
    out, between, looked = cluster.copy(), _squares(centres, centres), 0
    distance = ((x - centres[cluster]) ** 2).sum(1)
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        radius = distance[own].max()
        others = np.flatnonzero((between[c] <= 4 * radius) & (np.arange(len(centres)) != c))
        others = others[np.argsort(between[c, others], kind="stable")]
        # the annulus of a member: how many neighbours are near enough to win it; 0 is the stable core
        annulus = np.searchsorted(between[c, others], 4 * distance[own], "right")
        for a in np.unique(annulus[annulus > 0]):
            ring = own[annulus == a]
            compared = np.sort(np.append(others[:a], c))
            squares = _squares(x[ring], centres[compared])
            looked += len(ring) * int(a)
            least = squares.argmin(1)  # the first of equals
            out[ring], distance[ring] = compared[least], squares[np.arange(len(ring)), least]
    return out, distance, looked


def _assigner(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column(1), centres.shape[1])
            if batch.num_columns > 2:
                cluster, distance, _ = moved_members(x, batch.column(2).to_numpy(), centres)
            else:
                squares = _squares(x, centres)
                cluster = squares.argmin(1)
                distance = squares[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance.astype(np.int64))], ["vec_id", "packed", "cluster", "distance"])

    return assign_batches


def _summer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial sums of each cluster and component, and at dimension -1 the members; a component's sum of a batch fits a long."""

    def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _unpacked(batch.column(0), width).astype(np.int64), batch.column(1).to_numpy()
            for c in np.unique(cluster):
                members = x[cluster == c]
                sums = np.append(members.sum(0), len(members))
                dims = np.append(np.arange(width, dtype=np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, c, np.int32)), pa.array(dims), pa.array(sums)], ["cluster", "dim", "part"])

    return sum_batches


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final integer centres)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    kept = materialize(rows.mapInArrow(_scaler(width, scale), KEPT))
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), F.hex("packed")).limit(k).select("packed").collect()
    if not first:
        return kept.select("vec_id", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, width), np.int64)
    centres = np.stack([np.frombuffer(bytes(r.packed), "<i4") for r in first]).astype(np.int64)
    assigned = kept
    for step in range(rounds + 1):
        names = [c for c in ("vec_id", "packed", "cluster") if c in assigned.columns]
        assigned = materialize(assigned.select(*names).mapInArrow(_assigner(centres.astype(np.float64)), ASSIGNED))
        if step < rounds:
            parts = assigned.select("packed", "cluster").mapInArrow(_summer(width), "cluster int, dim int, part long")
            sums = {(r.cluster, r.dim): int(r.total) for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("total")).collect()}
            for c in range(len(centres)):
                if n := sums.get((c, -1)):
                    centres[c] = [sums[c, d] // n for d in range(width)]
    return assigned.select("vec_id", "cluster", "distance"), centres


def summarised(vectors: DataFrame, **options: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    members, centres = clustered(vectors, **options)
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres.tolist())]
    sums = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centre
    each = {r.cluster: int(r.s) for r in sums}
    long = lambda x: x if x < 1 << 63 else None
    rows = [(c, long(each.get(c, 0)), long(sum(each.values())), d) for c, d in digests]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    """The query in DuckDB SQL, all centres compared with all vectors."""
    nearest = """a{n} AS (SELECT vec_id, c, cluster, distance FROM (
        SELECT v.vec_id, v.c, m.cluster, list_sum(list_transform(list_zip(v.c, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance, v.r FROM v CROSS JOIN m{n} m)
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"""
    moved = """s{n} AS (SELECT cluster, list(f ORDER BY d) AS c FROM (SELECT cluster, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
            FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) AS d FROM a{n}) GROUP BY cluster, d) GROUP BY cluster),
        m{next} AS (SELECT m.cluster, coalesce(s.c, m.c) AS c FROM m{n} m LEFT JOIN s{n} s USING (cluster))"""
    steps = ",\n".join([nearest.format(n=n) + ",\n" + moved.format(n=n, next=n + 1) for n in range(rounds)] + [nearest.format(n=rounds)])
    return f"""
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
               WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    m0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), c) - 1 AS INTEGER) AS cluster, c FROM v ORDER BY 1 LIMIT {k}),
    {steps}
    SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN m{rounds} m USING (cluster)
    """
