import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.operators import graph, latent, pairs, recruit, repeats


def test_positive_pairs(spark):
    frags = spark.createDataFrame([(1, 100), (2, 4), (3, 1)], "contig long, n int")
    got = pairs.positive_pairs(frags, 30).collect()
    own = [(r.i, r.j) for r in got if r.contig == 1]
    assert len(own) == 30 and all(j - i >= 92 for i, j in own)
    assert own and sum(r.contig == 2 for r in got) == 30 and sum(r.contig == 3 for r in got) == 30


def test_negative_pairs(spark):
    frags = spark.createDataFrame([(i, n) for i, n in enumerate([200, 100, 100, 90])], "contig long, n int")
    got = pairs.negative_pairs(frags, 100).collect()
    assert len(got) == 100 and all(r.a != r.b and r.i < [200, 100, 100, 90][r.a] and r.j < [200, 100, 100, 90][r.b] for r in got)
    with pytest.raises(RuntimeError):
        pairs.negative_pairs(frags.limit(1), 5)


def test_split_without_replacement(spark):
    ids = spark.range(50).select(F.col("id").alias("contig"))
    got = pairs.split_test(ids, 0.1).collect()
    assert len(got) == 50 and sum(r.test for r in got) == 5


def test_missing_coverage_raises(spark):
    frags = spark.createDataFrame([("V1", 0, 8)], "contig string, start int, end int")
    cover = spark.createDataFrame([("V0", 0, [1] * 20)], "contig string, sample int, depth array<int>")
    with pytest.raises(KeyError):
        pairs.fragment_coverage(frags, cover, 4, 2)


def test_neighbours_skip_self_and_connected(spark):
    near = spark.createDataFrame([(0, b, float(k)) for k, b in enumerate([0, 2, 1, 3])], "a long, b long, dist double")
    linked = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert [r.b for r in latent.nearest(near, 2, linked).orderBy("rank").collect()] == [2, 3]


def test_radius_join_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "contig long, centre array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for r in (0.5, 1.5, 3.0):
        want = {(i, j) for i in range(80) for j in range(80) if i != j and d[i, j] <= r}
        assert {(q.a, q.b) for q in latent.radius_pairs(df, r).collect()} == want


def test_communities_and_refinement(spark):
    edges = [(0, 1, 9.0), (2, 3, 9.0), (3, 4, 9.0), (2, 4, 9.0), (1, 2, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.range(6).select(F.col("id").alias("contig"))
    got = {r.contig: r.bin for r in graph.communities(nodes, df.where("weight >= 8"), 0.5).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}
    assert {r.contig: r.component for r in graph.components(nodes, df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}
    score = lambda p: p.withColumn("weight", F.lit(1.0))
    refined = {r.contig: r.bin for r in graph.numbered(graph.refined(nodes, df, score, 0.9, 3, 0.3, 0.4)).collect()}
    assert refined == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 2}
    spectral = {r.contig: r.bin for r in graph.communities(nodes, df, 1.0, "spectral", 2).collect()}
    assert spectral[2] == spectral[3] == spectral[4]
    with pytest.raises(ValueError):
        graph.communities(nodes, df, 1.0, "spectral")


def test_leiden_finds_planted_blocks():
    rng = np.random.default_rng(0)
    block = np.repeat(range(6), 15)
    i, j = np.triu_indices(90, 1)
    keep = rng.random(len(i)) < np.where(block[i] == block[j], 0.8, 0.03)
    label = graph.leiden(90, i[keep], j[keep], 0.3)
    assert len(set(zip(label, block))) == 6 == len(set(label))
    assert graph.cpm_quality(label, i[keep], j[keep], 0.3) > graph.cpm_quality(np.arange(90), i[keep], j[keep], 0.3)


def test_missing_pairs_bounded(spark):
    bins = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 1), (10, 1)], "contig long, bin long")
    edges = spark.createDataFrame([(1, 0)], "src long, dst long")
    assert graph.missing_pairs(bins, edges).count() == 9 and graph.missing_pairs(bins, edges, 4).count() == 4


def test_recruits_to_nearest_bin(spark):
    rng = np.random.default_rng(5)
    rows = [(c, s, float(d)) for c in range(8) for s in range(2) for d in rng.normal(10 if c % 2 else 50, 3, 200)]
    vectors = recruit.percentile_vectors(spark.createDataFrame(rows, "contig long, sample int, depth double"))
    bins = spark.createDataFrame([(c, c % 2) for c in range(6)], "contig long, bin int")
    lengths = spark.createDataFrame([(c, 1500 if c > 5 else 3000) for c in range(8)], "contig long, length int")
    got = {r.contig: r.bin for r in recruit.recruits(vectors, bins, lengths).collect()}
    assert all(b == c % 2 for c, b in got.items())


def test_terminal_repeats(spark):
    rng = np.random.default_rng(2)
    random = lambda n: "".join(rng.choice(list("ACGT"), n))
    end = random(40)
    near = end[:20] + ("A" if end[20] != "A" else "C") + end[21:]
    df = spark.createDataFrame([("yes", end + random(900) + end), ("near", end + random(900) + near), ("no", random(1000)), ("short", "")], "contig string, seq string")
    got = {r.contig: tuple(r)[1:] for r in repeats.terminal_repeats(df).collect()}
    assert got["yes"] == (0, 40, 940, 980) and "no" not in got and "short" not in got
    assert {r.contig: r.n for r in repeats.exact_repeats(df).collect()} == {"yes": 40}


def test_missing_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    bin_of = {f"V{i}": ("hot" if i < 60 else f"b{i % 7}") for i in range(120)}
    edges = {tuple(sorted(f"V{i}" for i in rng.choice(120, 2, replace=False))) for _ in range(900)}
    df = spark.createDataFrame([(a, b) if k % 2 else (b, a) for k, (a, b) in enumerate(edges)] + [("V1", "V1"), ("V2", "none")], "src string, dst string")
    bins = spark.createDataFrame(list(bin_of.items()), "contig string, bin string")
    names = sorted(bin_of)
    count = {b: list(bin_of.values()).count(b) for b in bin_of.values()}
    want = {(bin_of[a], a, b) for i, a in enumerate(names) for b in names[i + 1 :] if bin_of[a] == bin_of[b] and count[bin_of[a]] > 2 and (a, b) not in edges}
    got = [(r.bin, *sorted((r.src, r.dst))) for r in graph.missing_pairs(bins, df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for most in (1, 30, 400):
        drawn = [(r.bin, *sorted((r.src, r.dst))) for r in graph.missing_pairs(bins, df, most).collect()]
        assert len(drawn) == len(set(drawn)) and set(drawn) <= want
        for b in count:
            assert sum(r[0] == b for r in drawn) == min(most, sum(w[0] == b for w in want))
    assert {tuple(r) for r in graph.missing_pairs(bins, df, 30).collect()} != {tuple(r) for r in graph.missing_pairs(bins, df, 30, seed=777).collect()}


def brute_recruits(vectors, bin_of, length, least=3):
    samples = sorted({s for _, s in vectors})
    members = {}
    for c, b in bin_of.items():
        members.setdefault(b, []).append(c)
    out = {}
    for b, own in sorted(members.items()):
        if len(own) < least:
            continue
        intra = {s: np.mean([np.linalg.norm(vectors[x, s] - vectors[y, s]) for i, x in enumerate(own) for y in own[i + 1 :]]) for s in samples}
        for c, n in length.items():
            if 1024 < n < 2048 and all((c, s) in vectors for s in samples):
                far = [np.mean([np.linalg.norm(vectors[c, s] - vectors[x, s]) for x in own]) for s in samples]
                if all(f <= intra[s] for f, s in zip(far, samples)):
                    out[c] = min(out.get(c, (np.inf, b)), (np.mean(far), b))
    return out


@pytest.mark.parametrize("block", [7, 512])
def test_recruits_against_all_distances(spark, monkeypatch, block):
    monkeypatch.setattr(recruit, "BLOCK", block)
    rng = np.random.default_rng(6)
    centre = {b: rng.uniform(5, 60, 3) for b in range(6)}
    bin_of = {c: ("b0" if c < 40 else f"b{c % 6}") for c in range(80)}
    vectors, length = {}, {}
    for c in range(200):
        b = int(bin_of[c][1:]) if c in bin_of else c % 6
        length[c] = 3000 if c < 80 else int(rng.integers(1000, 2100))
        for s in range(3):
            if (c, s) != (150, 1):
                vectors[c, s] = np.sort(centre[b][s] + rng.normal(0, 3, 20)) + rng.normal(0, 1)
    df = spark.createDataFrame([(c, s, v.tolist()) for (c, s), v in vectors.items()], "contig long, sample int, pct array<double>")
    bins = spark.createDataFrame(list(bin_of.items()), "contig long, bin string")
    lengths = spark.createDataFrame(list(length.items()), "contig long, length int")
    computed = []
    got = {r.contig: (r.score, r.bin) for r in recruit.recruits(df, bins, lengths, computed=computed).collect()}
    want = brute_recruits(vectors, bin_of, length)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[c][1] == want[c][1] and abs(got[c][0] - want[c][0]) < 1e-9 for c in want)
    assert len(computed) == 3 and all(done < every / 2 for done, every in computed) and computed[2][0] <= computed[0][0]


def test_recruits_of_nothing(spark):
    df = spark.createDataFrame([], "contig long, sample int, pct array<double>")
    assert recruit.recruits(df, spark.createDataFrame([], "contig long, bin long"), spark.createDataFrame([], "contig long, length int")).count() == 0


def test_spread_communities_reach_the_quality_of_one_task(spark):
    """No group holds a component: all of them go through joins. Planted blocks, a chain, and vertices without edges."""
    rng = np.random.default_rng(1)
    block = np.repeat(range(4), 8)
    i, j = np.triu_indices(32, 1)
    keep = rng.random(len(i)) < np.where(block[i] == block[j], 0.9, 0.04)
    u, v = np.r_[i[keep], np.arange(40, 46)], np.r_[j[keep], np.arange(41, 47)]
    edges = spark.createDataFrame([(f"V{b:02}", f"V{a:02}") for a, b in zip(u, v)] + [("V00", "V00")], "src string, dst string")
    nodes = spark.createDataFrame([(f"V{k:02}",) for k in range(50)], "contig string")
    got = {r.contig: r.bin for r in graph.communities(nodes, edges, 0.3, largest=0).collect()}
    assert set(got) == {f"V{k:02}" for k in range(50)} and all(min(c for c in got if got[c] == b) == b for b in got.values())
    label = np.unique([got[f"V{k:02}"] for k in range(50)], return_inverse=True)[1]
    assert graph.cpm_quality(label, u, v, 0.3) >= graph.cpm_quality(graph.leiden(50, u, v, 0.3), u, v, 0.3) - 1e-9
    assert all(got[f"V{k:02}"] == f"V{k:02}" for k in (33, 39, 48))


def best_partition(n, u, v, gamma):
    """The best quality over all partitions of a few vertices."""
    best = -np.inf

    def grow(label):
        nonlocal best
        if len(label) == n:
            best = max(best, graph.cpm_quality(np.array(label), u, v, gamma))
            return
        for c in range(max(label, default=-1) + 2):
            grow([*label, c])

    grow([])
    return best


def test_leiden_against_the_best_of_all_partitions():
    rng = np.random.default_rng(7)
    reached = 0
    for _ in range(30):
        n = int(rng.integers(2, 9))
        i, j = np.triu_indices(n, 1)
        keep = rng.random(len(i)) < 0.5
        gamma = float(rng.choice([0.2, 0.4, 0.7]))
        best = best_partition(n, i[keep], j[keep], gamma)
        found = graph.cpm_quality(graph.leiden(n, i[keep], j[keep], gamma), i[keep], j[keep], gamma)
        assert best - 1.0 <= found <= best + 1e-9
        reached += found >= best - 1e-9
    assert reached >= 27


def test_seeds_lose_no_repeat(spark):
    """Edited ends of many kinds: what is aligned after the seed conditions is all that passes without them."""
    rng = np.random.default_rng(12)
    letters = np.array(list("ACGT"))
    rows = []
    for k in range(600):
        n = int(rng.integers(6, 120))
        end = rng.choice(letters, n)
        other = list(end)
        for _ in range(int(rng.integers(0, 1 + n // 12))):
            at = int(rng.integers(0, len(other)))
            kind = rng.integers(3)
            if kind == 0:
                other[at] = str(rng.choice(letters))
            elif kind == 1:
                other.insert(at, str(rng.choice(letters)))
            elif len(other) > 1:
                del other[at]
        body = "".join(rng.choice(letters, int(rng.integers(0, 400))))
        rows.append((f"V{k}", "".join(end) + body + "".join(other)))
    rows += [("empty", ""), ("null", None), ("one", "A"), ("poly", "A" * 700), ("eleven", "ACGTACGGTCA" + "T" * 50 + "ACGTACGGTCA")]
    df = spark.createDataFrame(rows, "contig string, seq string").repartition(4)
    for size, identity in ((10, 0.95), (5, 0.9)):
        want = sorted(map(tuple, repeats.terminal_repeats(df, size, min_identity=identity, seeds=False).collect()))
        assert sorted(map(tuple, repeats.terminal_repeats(df, size, min_identity=identity).collect())) == want and len(want) > 100


def test_missing_sums_of_whole_bins(spark, tmp_path):
    """q24 counts all missing pairs of a bin, also of one with more than missing_pairs draws; repeated contigs have pairs each."""
    import duckdb

    from helixbin.plans import queries

    rows = [(i, i % 3 if i % 100 else None) for i in range(1800)] + [(5000, 7), (5001, 7), (6000, 8), (6010, 8), (6020, 8), (7000, 9), (7000, 9), (7010, 9), (None, 9), (30, 0)]
    spark.createDataFrame([(i, [0.0], b) for i, b in rows], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["q24_missing_pairs"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["q24_missing_pairs"]).fetchall())
    assert got == want and max(n for _, n, _ in want) > 100_000


def test_ends_of_alignments_side_by_side():
    """best_ends of a batch of pairs of many lengths is where align ends, ties included."""
    rng = np.random.default_rng(14)
    word = lambda n, letters="ACGT": "".join(rng.choice(list(letters), n))
    pairs_ = []
    for k in range(150):
        core = word(int(rng.integers(1, 30)), "AC" if k % 3 else "ACGT")
        pairs_.append((core + word(int(rng.integers(0, 40))), word(int(rng.integers(0, 40))) + core[: max(1, len(core) - k % 3)]))
    pairs_ += [("A", "C"), ("A", "A"), ("AAAA", "AA"), ("ACAC", "ACACAC"), ("A" * 90, "A" * 80)]
    ends = repeats.best_ends([h.encode() for h, _ in pairs_], [t.encode() for _, t in pairs_])
    for (h, t), i, j in zip(pairs_, *ends):
        assert (i, j) == (repeats.align(h, t)[1], repeats.align(h, t)[3]), (h, t)
    assert repeats.traced([h.encode() for h, _ in pairs_], [t.encode() for _, t in pairs_]) == [repeats.align(h, t) for h, t in pairs_]


def test_recruits_send_few_copies(spark):
    """A side of some thousand vectors is one block, so that the other side is sent once."""
    rows = spark.range(5000).select((F.col("id") % 1).alias("bin"), F.col("id").alias("ref"))
    assert recruit._blocked(rows, ["bin"], "ref", "block").agg(F.max("blocks")).first()[0] == 1


def test_distance_sums_by_products():
    """Copies and vectors that nearly agree, far from the origin, beside others; weights count references that are one row."""
    rng = np.random.default_rng(19)
    y = np.concatenate([rng.normal(size=(300, 20)), 1e6 + rng.normal(size=(30, 20)), np.zeros((1, 20))])
    x = np.concatenate([y[::7], y[::5] + 1e-7, rng.normal(size=(300, 20))])
    weight = rng.integers(1, 5, len(y)).astype(float)
    want = [(np.linalg.norm(y - row, axis=1) * weight).sum() for row in x]
    assert np.allclose(recruit._sums(x, y, weight), want, rtol=1e-10, atol=0)
    same = np.repeat(y[:1], 3, axis=0)
    assert (recruit._sums(same, same, np.ones(3)) == 0).all()


def test_recruits_compare_equal_vectors_once(spark):
    """Every query was compared with every reference by itself, copies too."""
    rng = np.random.default_rng(20)
    kinds = np.sort(rng.normal(20, 4, (12, 2, 10)))
    vectors = {(c, s): kinds[c % 12, s] for c in range(240) for s in range(2)}
    bin_of, length = {c: c % 2 for c in range(60)}, {c: 1500 for c in range(240)}
    df = spark.createDataFrame([(c, s, v.tolist()) for (c, s), v in vectors.items()], "contig long, sample int, pct array<double>")
    computed = []
    bins, lengths = (spark.createDataFrame(list(d.items()), f"contig long, {n} long") for d, n in ((bin_of, "bin"), (length, "length")))
    got = {r.contig: (r.score, r.bin) for r in recruit.recruits(df, bins, lengths, computed=computed).collect()}
    want = brute_recruits(vectors, bin_of, length)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[c][1] == want[c][1] and abs(got[c][0] - want[c][0]) < 1e-9 for c in want)
    assert all(10 * done <= every for done, every in computed), computed
