"""Ball k-means against plain k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from helixbin.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, packed string, inertia long"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, "p", 3) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k, rounds, width, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            c = [math.floor(scale * float(np.float32(x))) for x in v]
            if all(abs(x) < 1 << 20 for x in c):
                kept.append((i, c))
    packed = lambda c: np.array(c, "<i4").tobytes().hex()
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", packed(r[1]))
    centres = [c for _, c in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        near = [min((square(c, m), j) for j, m in enumerate(centres)) for _, c in kept]
        if step < rounds:
            for j in range(len(centres)):
                own = [c for (_, c), (_, n) in zip(kept, near) if n == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    total = sum(s for s, _ in near)
    each = [sum(s for s, n in near if n == j) for j in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted(((i, n, s, each[n], total, sha[n]) for (i, _), (s, n) in zip(kept, near)), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_plain_k_means(spark, spread):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 4))
    rows = [(i, [float(x) for x in base[i % 6] + spread * rng.normal(size=4)]) for i in range(500)]
    rows += [(1000 + i, [float(x) for x in base[0]]) for i in range(250)] + [(7, rows[7][1]), (7, [0.0] * 4), (None, [1.0] * 4)]
    rows += [(600, None), (601, []), (602, [1.0] * 3), (603, [1.0] * 5), (604, [1.0, None, 1.0, 1.0]), (605, [float("nan")] * 4), (606, [float("-inf")] * 4), (607, [1e30] * 4)]
    assert got(centroids.summarised(table(spark, rows), k=9, rounds=3, width=4)) == brute(rows, 9, 3, 4)


def test_ties_and_equal_centres(spark):
    """Members half-way between centres and centres of the same place: the smaller number wins."""
    grid = [(i, [float(i % 5) / 16, float(i // 5) / 16]) for i in range(25)]
    rows = grid + [(100 + i, [0.0, 0.0]) for i in range(40)]
    for k in (2, 7, 16):
        assert got(centroids.summarised(table(spark, rows), k=k, rounds=4, width=2)) == brute(rows, k, 4, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, -2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_few_rows(spark, rows):
    assert got(centroids.summarised(table(spark, rows, 1), width=2)) == brute(rows, 16, 3, 2)


def test_core_is_not_compared():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (20, 16)).astype(float)
    x = np.repeat(centres, 50, 0) + rng.integers(-4, 5, (1000, 16))
    cluster = np.repeat(np.arange(20), 50)
    near, distance, looked = centroids.moved_members(x, cluster, centres)
    assert looked == 0 and (near == cluster).all()
    moved = centres + rng.integers(-60, 60, centres.shape)
    near, distance, looked = centroids.moved_members(x, cluster, moved)
    squares = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (near == squares.argmin(1)).all() and (distance == squares.min(1)).all() and 0 < looked < 19 * 1000
