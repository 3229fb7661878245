"""Approximate neighbours against the exact join, and exact percentiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.operators import latent, neighbours, selection


def centres_of(spark, x, names=None):
    return spark.createDataFrame([(names[i] if names else i, v.tolist()) for i, v in enumerate(x)], f"contig {'string' if names else 'long'}, centre array<double>")


@pytest.mark.parametrize("kind", ["clusters", "ball"])
def test_recall_against_the_exact_join(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(25, 16)), 32, 0) + 0.15 * rng.normal(size=(800, 16))
        r, degree = 1.0, 64
    else:
        x, r, degree = rng.normal(size=(800, 8)), 1.3, 64
    df = centres_of(spark, x)
    want = {(q.a, q.b) for q in latent.radius_pairs(df, r).collect()}
    near = neighbours.near_pairs(df, r, degree).collect()
    got = {(q.a, q.b): q.dist for q in near}
    assert len(near) == len(got) and got.keys() <= want and len(want) > 500
    assert len(got) >= 0.9 * len(want)
    assert all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-9 for (a, b), d in got.items())


def test_degree_is_bounded_and_repeats_are_handled(spark):
    """A third of the centres is one point: the hub of every list; no contig keeps more than its degree."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((100, 4)), rng.normal(size=(200, 4))])
    names = [f"V{i}" for i in range(300)]
    graph = neighbours.neighbour_graph(centres_of(spark, x, names), 10).collect()
    count = {}
    for e in graph:
        count[e.a] = count.get(e.a, 0) + 1
        assert e.a != e.b
    assert set(count) == set(names) and set(count.values()) == {10}
    assert sum(e.dist == 0 for e in graph if int(e.a[1:]) < 100) >= 990


def test_candidate_pairs_past_the_parameter(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 8)), 10, 0) + 0.1 * rng.normal(size=(200, 8))
    rows = [(c, f, (x[c] + 0.05 * rng.normal(size=8)).tolist()) for c in range(200) for f in range(4)]
    features = [spark.createDataFrame(rows, "contig long, frag int, vec array<double>")] * 2
    exact = set(map(tuple, latent.candidate_pairs(features, 5, 3.0).collect()))
    near = set(map(tuple, latent.candidate_pairs(features, 5, 3.0, exact_contigs=100, degree=40).collect()))
    assert len(exact & near) >= 0.9 * len(exact) > 300


def test_empty_and_single(spark):
    for x in (np.zeros((0, 3)), np.zeros((1, 3))):
        assert neighbours.near_pairs(centres_of(spark, x), 1.0).count() == 0


@pytest.mark.parametrize("gathered", [1, 7, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_percentile_is_exact(spark, gathered, q):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=997), rng.integers(0, 4, 500).astype(float), np.full(60, 2.5), np.array([3.0]), np.concatenate([np.zeros(900), rng.normal(size=90) * 1e9, [1e-300] * 9])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "dist double")
        assert np.isclose(selection.percentile(df, "dist", q, gathered), np.percentile(values, 100 * q), rtol=1e-12, atol=0)


def test_percentile_of_nothing(spark):
    assert selection.percentile(spark.range(0).select(F.col("id").cast("double").alias("v")), "v", 0.9) is None


@pytest.mark.parametrize("block,stripe", [(8192, 256), (17, 5)])
def test_radius_pairs_by_blocks(spark, monkeypatch, block, stripe):
    """Exact at the radius, with copies, over one block or many; beside the bound of the pivot no pair is lost."""
    monkeypatch.setattr(latent, "BLOCK", block)
    monkeypatch.setattr(latent, "STRIPE", stripe)
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(90, 3)), 100 + rng.normal(size=(40, 3)), np.zeros((6, 3)), [[0.75, 0, 0], [0, 0.75, 0]]])
    got = {(q.a, q.b): q.dist for q in latent.radius_pairs(centres_of(spark, x), 0.75).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert got.keys() == {(i, j) for i, j in zip(*np.nonzero(d <= 0.75)) if i != j}
    assert all(abs(v - d[k]) < 1e-12 for k, v in got.items()) and got[130, 136] == 0.75


def test_meetings_equal_all_differences():
    """Products only leave out pairs: what meets, copies and ties at the last distance included, is what the differences say."""
    import pyarrow as pa

    rng = np.random.default_rng(17)
    hubs = []
    for k in range(20):
        x = rng.integers(-3, 4, (12, 4)) * 1000.5 if k % 2 else 50 + rng.normal(size=(12, 4))
        x[1] = x[0]
        last = [float("inf") if t == 0 else float(np.linalg.norm(x[t] - x[5])) for t in range(12)]
        hubs.append([{"id": 100 * k + t, "vec": x[t].tolist(), "fresh": bool(rng.random() < 0.5), "last": last[t]} for t in range(12)])
    kind = pa.list_(pa.struct([("id", pa.int64()), ("vec", pa.list_(pa.float64())), ("fresh", pa.bool_()), ("last", pa.float64())]))
    got = [r for b in neighbours._met(iter([pa.RecordBatch.from_arrays([pa.array(hubs, kind)], ["members"])])) for r in b.to_pylist()]
    dist = lambda p, q: float(np.sqrt(((np.array(p["vec"]) - np.array(q["vec"])) ** 2).sum()))
    want = [(p["id"], q["id"]) for h in hubs for p in h for q in h if p is not q and (p["fresh"] or q["fresh"]) and dist(p, q) <= p["last"]]
    assert [(r["a"], r["b"]) for r in got] == want and len(want) > 500


@pytest.mark.parametrize("block,stripe", [(8192, 256), (17, 5)])
def test_nearest_common_is_bounded(spark, monkeypatch, block, stripe):
    """All pairs within the radii were gathered in a task's memory; of many copies no more than k rows of a centre leave a pair of blocks."""
    monkeypatch.setattr(latent, "BLOCK", block)
    monkeypatch.setattr(latent, "STRIPE", stripe)
    rng = np.random.default_rng(18)
    x = [np.concatenate([rng.normal(size=(50, 3)), np.repeat(rng.normal(size=(4, 3)), 15, axis=0), np.full((1, 3), 50.0)]) for _ in range(2)]
    centres = [centres_of(spark, v) for v in x]
    got = latent.nearest_common(centres, [1.5, 1.2], 4).collect()
    blocks = -(-len(x[0]) // block)
    assert len(got) <= 4 * len(x[0]) * blocks
    near = latent.common_neighbours([latent.radius_pairs(c, r) for c, r in zip(centres, (1.5, 1.2))])
    want = {(r.a, r.b, r.dist, r["rank"]) for r in latent.nearest(near, 4).collect()}
    found = spark.createDataFrame(got, "a long, b long, dist double")
    assert {(r.a, r.b, r.dist, r["rank"]) for r in latent.nearest(found, 4).collect()} == want and len(want) > 200
