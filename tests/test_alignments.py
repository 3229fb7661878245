from pyspark.sql import functions as F

from helixbin.operators import alignments as A

SCHEMA = "contig string, flag int, mapq int, ref_start int, ref_end int, tlen int, qlen int, qalen int"
READS = [
    ("V0", 0, 60, 0, 5, 100, 5, 5), ("V0", 0, 60, 3, 10, -200, 7, 7), ("V0", 0, 10, 1, 4, 100, 5, 5),  # low quality
    ("V0", 1024, 60, 1, 4, 100, 5, 5), ("V0", 256, 60, 2, 4, 100, 5, 5), ("V0", 0, 60, 0, 2, 100, 10, 2), ("V0", 0, 60, 0, 2, 5000, 2, 2),
]


def reads(spark):
    return spark.createDataFrame(READS, SCHEMA)


def test_depth_and_runs_agree(spark):
    tests = A.predicates(30, 50, 3596, (1, 1000))
    spanned = A.spans(reads(spark).where(A.accepted(tests)))
    want = [0] * 10
    for a, b in ((0, 5), (3, 10), (2, 4)):
        for p in range(a, b):
            want[p] += 1
    depth = {r.pos: r.depth for r in A.depth(spanned, ["contig"]).collect()}
    assert depth == {p: d for p, d in enumerate(want) if d}
    flat = {}
    for r in A.runs(spanned, ["contig"]).collect():
        flat |= {p: r.depth for p in range(r.start, r.end)}
    assert flat == depth
    dense = A.zero_filled(A.runs(spanned, ["contig"]), spark.createDataFrame([("V0", 12), ("V1", 2)], "contig string, length int"), ["contig"])
    assert {r.contig: r.depth for r in dense.collect()} == {"V0": want + [0, 0], "V1": [0, 0]}


def test_compat_keeps_low_quality_and_shifts(spark):
    tests = A.predicates(30, 50, 3596, (1, 1000))
    assert reads(spark).where(A.accepted(tests)).count() == 3 and reads(spark).where(A.accepted(tests, True)).count() == 4
    assert A.spans(reads(spark), True).where("start = 2").first().end == 10


def test_counters(spark):
    row = A.counters(reads(spark), ["contig"], A.predicates(30, 50, 3596, (1, 1000))).first()
    assert (row.total, row.primary, row.mapped, row.quality, row.aligned, row.flagged, row.template) == (7, 6, 7, 6, 6, 6, 6)
    assert row.primary_fraction == round(6 / 7, 6)


def test_length_filter(spark):
    df = spark.createDataFrame([("a", "A" * 20), ("b", "acgtNnNNnACGTAA"), ("c", "C" * 15)], "contig string, seq string")
    got = {r.contig: (r.length, r.kept) for r in A.by_length(df, 12).collect()}
    assert got == {"a": (20, True), "b": (10, False), "c": (15, True)}


def test_prevalence_and_log(spark):
    cover = [(f"V{c}", s, d) for c in range(3) for s, d in enumerate((20, 40, 30)) if not (c == 1 and s < 2)]
    depths = spark.createDataFrame([(c, s, d * 10) for c, s, d in cover], "contig string, sample int, depth int")
    lengths = spark.createDataFrame([(f"V{c}", 10) for c in range(4)], "contig string, length int")
    got = {r.contig: (r.prevalence, r.kept) for r in A.prevalence(depths, lengths).collect()}
    assert got == {"V0": (3, True), "V1": (1, False), "V2": (3, True), "V3": (0, False)}
    gone = {r.contig: tuple(r)[1:] for r in A.exclusions(depths, lengths, [0, 1, 2]).collect()}
    assert gone == {"V1": ("prevalence", "0.0,0.0,30.0"), "V3": ("prevalence", "0.0,0.0,0.0")}


def test_mask_and_sync(spark):
    df = spark.createDataFrame([("a", "ANNCg")], "contig string, seq string")
    assert [(r.pos, r.new_pos) for r in A.valid_positions(df).orderBy("pos").collect()] == [(0, 0), (3, 1), (4, 2)]
    cover = spark.createDataFrame([("a", p, p * 10) for p in range(5)], "contig string, pos int, depth int")
    assert [(r.pos, r.depth) for r in A.masked(cover, df).orderBy("pos").collect()] == [(0, 0), (1, 30), (2, 40)]
    runs = spark.createDataFrame([("a", 0, 2, 7), ("a", 2, 4, 8)], "contig string, start int, end int, depth int")
    assert sorted((r.start, r.end, r.depth) for r in A.masked_runs(runs, df).collect()) == [(0, 1, 7), (1, 2, 8)]
    odd = spark.createDataFrame([("n", "NNN"), ("e", ""), ("w", "acg")], "contig string, seq string")
    assert sorted(map(tuple, A.valid_runs(odd).collect())) == [("w", 0, 3, 0)]
    long = A.zero_filled(spark.createDataFrame([("a", p, p + 1, p) for p in range(0, 60000, 3)], "contig string, start int, end int, depth int"), spark.createDataFrame([("a", 60000)], "contig string, length int"), ["contig"])
    assert long.first().depth == [p if p % 3 == 0 else 0 for p in range(60000)]
    x, y = (spark.createDataFrame([(c,) for c in s], "contig string") for s in ("abc", "bcd"))
    assert {r.contig: r.side for r in A.synchronized(x, y).collect()} == {"a": "left", "b": "both", "c": "both", "d": "right"}
    assert A.without_ids(x, y).select(F.collect_list("contig")).first()[0] == ["a"]
