"""Batches made on executors against vectors made here, and training there against training here."""

import numpy as np
import pytest

from helixbin.operators import embed, network, training

SHAPES = {"composition": (136,), "coverage": (5, 2)}


def fragments(rng, n):
    return [(f"V{k % 7}", k // 7, "".join(rng.choice(list("ACGTN"), 60, p=[0.3, 0.3, 0.2, 0.19, 0.01])), rng.integers(0, 9, (2, 12)).tolist()) for k in range(n)]


def model():
    return network.Model({"composition": network.Branch((136,), (8, 4)), "coverage": network.Branch((5, 2), (8, 4), filters=2, kernel=3, stride=1)}, 2)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(0)
    rows = fragments(rng, 70)
    frame = spark.createDataFrame(rows, "contig string, f int, seq string, depth array<array<int>>").repartition(3)
    vectors = training.fragment_vectors(frame, list(SHAPES), width=4, step=2)
    pairs = []
    for _ in range(203):
        (a, i, *_), (b, j, *_) = (rows[k] for k in rng.integers(0, 70, 2))
        pairs.append((a, i, b, j, int(a == b)))
    pairs += pairs[:5]  # repeated pairs stay
    frame = spark.createDataFrame(pairs, "a string, i int, b string, j int, label int")
    return rows, pairs, training.numbered_batches(frame, vectors, list(SHAPES), 16, 3), training.numbered_batches(frame, vectors, list(SHAPES), 16, 3, remainder=True)


def test_vectors_and_numbers(made):
    rows, pairs, table, whole = made
    index = embed.kmer_index(4)
    want = {(c, f): (embed.kmer_vector(s, 4, index), embed.window_means(np.array(d, float), 4, 2)) for c, f, s, d in rows}
    got = table.collect()
    assert len(got) == 208 // 16 * 16 and whole.count() == 208
    assert sorted(r.place for r in got) == list(range(208)) and all(r.batch == r.place // 16 for r in got)
    for r in got[:50]:
        assert np.array_equal(r.a_composition, want[r.a, r.i][0]) and np.allclose(np.reshape(r.b_coverage, (2, 5)), want[r.b, r.j][1])
    assert sorted((r.a, r.i, r.b, r.j, r.label) for r in got) == sorted(pairs)
    order = [(r.a, r.i) for r in sorted(got, key=lambda r: r.place)]
    assert order != sorted(order) and order != [p[:2] for p in pairs]


@pytest.mark.parametrize("load_batch", [1, 4, 100])
def test_batches_are_read_in_order(made, load_batch):
    table = made[2]
    places = [r.label for r in sorted(table.collect(), key=lambda r: r.place)]
    batches = list(training.read_batches(table, SHAPES, load_batch))
    assert [len(y) for *_, y in batches] == [16] * 13 and np.concatenate([y for *_, y in batches]).tolist() == places
    assert batches[0][0]["coverage"].shape == (16, 2, 5) and batches[0][1]["composition"].shape == (16, 136)


def test_training_on_executors_equals_training_here(made):
    _, _, table, held = made
    here, there = model(), model()
    batches = list(training.read_batches(table, SHAPES))
    test = [np.concatenate(x) if k == 2 else {n: np.concatenate([b[n] for b in x]) for n in SHAPES} for k, x in enumerate(zip(*training.read_batches(held, SHAPES)))]
    want = network.train(here, lambda: iter(batches), tuple(test), 1e-2, 4, 3, 13)
    got = training.train(there, table, held, SHAPES, 1e-2, 4, 3)
    assert np.allclose(want, got, atol=1e-9) and len(got) == 4
    for k, v in here.parameters().items():
        assert np.allclose(v, there.parameters()[k], atol=1e-9)
    p = {r.place: r.combined for r in training.predicted(held, there, SHAPES).collect()}
    assert np.allclose([p[k] for k in range(208)], there.forward(test[0], test[1])["combined"], atol=1e-6)


def test_shards_are_averaged(spark):
    """Four shards learn blocks of k-mers as one does."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 10)) * 3
    rows = [(f"V{k}", 0, (centres[k % 4] + rng.normal(size=10)).tolist()) for k in range(400)]
    vectors = spark.createDataFrame(rows, "contig string, f int, composition array<float>")
    draws = rng.integers(0, 400, (6000, 2))
    draws[::2, 1] = draws[::2, 0] + 4 * rng.integers(-99, 100, 3000)
    draws = draws[(draws[:, 1] >= 0) & (draws[:, 1] < 400)]
    pairs = spark.createDataFrame([(f"V{a}", 0, f"V{b}", 0, int(a % 4 == b % 4)) for a, b in draws.tolist()], "a string, i int, b string, j int, label int")
    table = training.numbered_batches(pairs, vectors, ["composition"], 16)
    net = network.Model({"composition": network.Branch((10,), (16, 8))})
    losses = training.train(net, table.where("batch > 10"), table.where("batch <= 10"), {"composition": (10,)}, 1e-2, 60, 50, shards=4)
    assert losses[-1] < 0.6 * losses[0]


def test_no_batches(spark, made):
    net = model()
    before = {k: v.copy() for k, v in net.parameters().items()}
    assert training.train(net, made[2].where("false"), made[3], SHAPES) == []
    assert all((before[k] == v).all() for k, v in net.parameters().items()) and list(training.read_batches(made[2].where("false"), SHAPES)) == []
