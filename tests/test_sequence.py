import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.functions import sequence as S
from helixbin.operators import embed


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("canonical", [False, True])
def test_kmers_equal_brute_force(spark, canonical):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (10, 60, 3, 4)] + ["ACGTNACGTRAAAA", ""]
    got = S.kmer_counts(spark.createDataFrame(list(enumerate(seqs)), "contig long, seq string"), ["contig"], 4, canonical).collect()
    want = Counter()
    for i, s in enumerate(seqs):
        for j in range(len(s) - 3):
            w = s[j : j + 4]
            if set(w) <= set("ACGT"):
                want[i, min(w, rc(w)) if canonical else w] += 1
    assert {(r.contig, r.kmer): r.n for r in got} == dict(want)


def test_kmer_totals_and_vectors():
    assert S.kmer_total(4) == 136 and S.kmer_total(4, False) == 256 and S.kmer_total(3) == 32
    index = embed.kmer_index(4)
    assert index.max() + 1 == 136
    v = embed.kmer_vector("ACGTACGTNAAAATTTT", 4, index)
    w = embed.kmer_vector(rc("ACGTACGTNAAAATTTT".replace("N", "N")), 4, index)
    assert v.sum() == 10 and (v == w).all()


def test_averaging_window(spark):
    row = spark.range(1).select(S.averaged(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 5.0])), 3, 2).alias("x"), S.averaged(F.array(F.lit(1.0)), 3, 2).alias("y")).first()
    assert row.x == [2.0, 4.0] and row.y == []


def test_window_means_agree(spark):
    x = [float(i * i % 17) for i in range(101)]
    got = spark.range(1).select(S.averaged(F.array(*map(F.lit, x)), 8, 4).alias("x")).first().x
    import numpy as np

    assert got == pytest.approx(embed.window_means(np.array(x), 8, 4).tolist())


@pytest.mark.parametrize("n,fppc,want", [(50, 5, 47), (100, 30, 92), (10, 100, -3)])
def test_optimal_distance(spark, n, fppc, want):
    assert spark.range(1).select(S.optimal_distance(F.lit(n), fppc).alias("d")).first().d == want


def test_fragments(spark):
    df = spark.createDataFrame([("V0", "A" * 60), ("V1", "A" * 19)], "contig string, seq string")
    train = S.training_fragments(df, 20, 2, F.length("seq")).orderBy("start").collect()
    assert len(train) == (1 + 60 - 20) // 2 and (train[3].start, train[3].end) == (6, 26)
    late = S.latent_fragments(df, 20, 5, F.length("seq")).orderBy("frag").collect()
    assert [(r.start, r.end) for r in late] == [(8 * i, 8 * i + 20) for i in range(5)]


@pytest.mark.parametrize("canonical", [True, False])
@pytest.mark.parametrize("keys", [["contig"], []])
def test_counted_kmers_equal_exploded_ones(spark, canonical, keys):
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGTNacgt"), int(n), p=[0.23] * 4 + [0.04] + [0.01] * 4)) for n in rng.integers(0, 60, 300)]
    rows = [(k % 40, s) for k, s in enumerate(seqs)] + [(0, None), (1, ""), (2, "ACG"), (3, "ACGT" * 5000), (None, "ACGTACGT")]
    df = spark.createDataFrame(rows, "contig long, seq string").repartition(3)
    for k in (1, 3, 4):
        want = S.kmers(df, keys, k, canonical).groupBy(*keys, "kmer").count()
        assert sorted(map(str, S.kmer_counts(df, keys, k, canonical).collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())


def test_masked_runs_against_positions(spark, monkeypatch):
    from helixbin.operators import alignments as A

    monkeypatch.setattr(A, "BIN", 16)
    rng = np.random.default_rng(10)
    seqs = {c: "".join(rng.choice(list("ACGTN"), 200, p=[0.2, 0.2, 0.2, 0.2, 0.2])) for c in ("a", "b")} | {"none": "N" * 50, "all": "A" * 300}
    runs = [(c, s, int(lo), int(lo + n), 1 + s) for c in seqs for s in range(2) for lo, n in zip(rng.integers(0, 250, 15), rng.integers(0, 90, 15))]
    got = A.masked_runs(spark.createDataFrame(runs, "contig string, sample int, start int, end int, depth int"), spark.createDataFrame(list(seqs.items()), "contig string, seq string"))
    place = {c: np.cumsum([x != "N" for x in s]) - 1 for c, s in seqs.items()}
    want = sorted((c, s, int(place[c][p]), d) for c, s, lo, hi, d in runs for p in range(lo, min(hi, len(seqs[c]))) if seqs[c][p] != "N")
    assert sorted((r.contig, r["sample"], p, r.depth) for r in got.collect() for p in range(r.start, r.end)) == want


@pytest.mark.parametrize("rows_out", [1, 3, 256])
def test_counts_of_a_key_over_many_batches(rows_out, monkeypatch):
    """Sums carry a row a sequence: keys in order, some in many rows over several batches, two of them or none known."""
    import pyarrow as pa

    monkeypatch.setattr(S, "ROWS_OUT", rows_out)
    rng = np.random.default_rng(15)
    keys = sorted([(int(a), str(b)) for a, b in zip(rng.integers(0, 4, 40), rng.choice(list("xyz"), 40))]) + [(7, None)] * 3 + [(None, None)] * 2
    rows, want = [], Counter()
    for key in keys:
        counts = Counter(rng.integers(0, 256, 30).tolist())
        rows.append((np.array(list(counts), "<u2").tobytes(), np.array(list(counts.values()), "<i8").tobytes()))
        want.update({(*key, c): n for c, n in counts.items()})
    columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["k0", "k1", "codes", "counts"])
    out = list(S._summed(4)(iter([batch.slice(i, 7) for i in range(0, len(keys), 7)])))
    got = Counter({(r["k0"], r["k1"], S._names(4).index(r["kmer"])): r["n"] for b in out for r in b.to_pylist()})
    assert got == want and sum(map(len, out)) == len(want)
