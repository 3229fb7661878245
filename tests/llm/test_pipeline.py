import hashlib
import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.llm import mixing, neardup
from helixbin.llm.common import materialize

WS = r"[^ \t-\r]+"
CLASHES = {"_p": "long", "_key": "string", "key": "string", "row": "long", "h": "string", "size": "long", "position": "double", "part": "string", "c": "string", "n": "long", "copies": "string", "class_id": "string"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in CLASHES.items())


def corpus():
    """Clean texts, copies, near copies, repeated lines, nulls, ties and repeated rows, with clashing columns that name the row."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgé"), int(rng.integers(2, 9)))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(words, n))
    texts = ["\n".join(line(30) for _ in range(4)) for _ in range(30)]
    near = texts[3].split(" ")
    near[50] = "changed"
    texts += [texts[0], texts[1], " ".join(near), texts[4] + "\n" + texts[5].split("\n")[2], "", None, " \n ", "too short", line(60) + "\n" + line(4000)]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[8], "en", "s1"), (40, line(70), None, None), (40, line(70), "en", "s0")]
    value = lambda t, k: f"v{k}" if t == "string" else float(k) if t == "double" else k
    return [(*r, None if r[1] is None else len(r[1]), *(None if k % 6 == 0 else value(t, k) for t in CLASHES.values())) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def counted(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_stage_drops_rows_only(spark, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    got, every = counted(kept.collect()), counted(docs.collect())
    assert not got - every
    gone = every - got
    assert all(len(re.findall(WS, r[1] or "")) < 50 or len(r[1]) > 10_000 for r in gone)
    assert all(len(re.findall(WS, r[1] or "")) >= 50 for r in got)


def test_line_stage(spark, docs):
    """Distinct ids only: of equal ids the order is not fixed."""
    many = [i for i, n in Counter(r.doc_id for r in docs.collect()).items() if n > 1]
    own = docs.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(many))
    seen, want = [], Counter()
    for r in sorted(own.collect(), key=lambda r: r.doc_id):
        left = []
        for line in (r.text or "").split("\n"):
            k = set(re.findall(WS, line))
            if not any(k and len(k & s) / len(k | s) >= 0.8 - 1e-12 for s in seen):
                left.append(line)
            seen += [k] * bool(k)
        text = "\n".join(left)
        if re.search(WS, text):
            want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
    assert counted(corpus_pipeline.line_dedup(spark, own, "").collect()) == want


def test_near_stage(spark, docs):
    """One row of each class of equal or near texts stays as it is, and every class has one."""
    rows = docs.collect()
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = got.collect()
    assert not counted(kept) - counted(rows)
    words = lambda t: re.findall(WS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = lambda t: {tuple(w[i : i + 5]): 1 for w in [words(t)] for i in range(max(1, len(w) - 4)) if w}
    texts = list({r.text or "" for r in rows})
    group = {t: t for t in texts}
    for a, b in itertools.combinations(texts, 2):
        x, y = shingles(a), shingles(b)
        if x and y and len(x.keys() & y.keys()) / len(x.keys() | y.keys()) >= 0.8:
            old = group[b]
            group = {t: group[a] if g == old else g for t, g in group.items()}
    assert Counter(group[r.text or ""] for r in kept) == Counter(set(group.values()))


def test_mix_stage(spark, docs):
    """Every row has as many copies as its share of the plan gives, and comes back whole, whatever its columns are called."""
    got = corpus_pipeline.source_mix(spark, docs, "")
    assert got.columns == docs.columns
    rows = docs.collect()
    taken = got.collect()
    assert set(counted(taken)) <= set(counted(rows))
    size = lambda r: len(re.findall(WS, r.text or ""))
    plan = mixing.planned(docs).agg(*(F.sum(c).alias(c) for c in ("taken",))).first()["taken"]
    assert abs(sum(map(size, taken)) - plan) <= 3 * max(map(size, rows))
    for r, n in counted(rows).items():
        assert counted(taken)[r] <= 3 * n
    one = corpus_pipeline.source_mix(spark, docs.repartition(5), "").collect()
    assert counted(one) == counted(taken)
    assert [r.doc_id for r in one] == [r.doc_id for r in taken] or len({r.doc_id for r in rows}) < len(rows)


def test_null_and_text_that_marks_it_stay_apart(spark):
    rows = [(1, "one two three", None, "a", 1), (1, "one two three", "-", "a", 1), (1, "one two three", "\x1e", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert set(map(tuple, corpus_pipeline.source_mix(spark, frame, "").collect())) == set(rows)


def test_tokens_stage(spark, docs):
    got = corpus_pipeline.tokenized(spark, docs, "").collect()
    want = Counter((r.doc_id, r.source, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r.decoded_sha256) for r in got) == want


def test_run_keeps_clean_documents(spark, docs):
    """Through all stages: what is left is what the stages leave one after the other, and clean documents are among it."""
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = materialize(stage(spark, rows, ""))
    left = rows.collect()
    clean = {i for i in range(6, 30)}
    assert {r.doc_id for r in left} >= clean - {8}
    assert neardup.one_of_each(rows).count() == len(left)


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, rows = docs.columns, docs.count()
    assert [int(k.split()[0]) for k, _ in corpus_pipeline.STAGES] == [4, 10, 9, 2, 3]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == names
        docs = materialize(docs)
        assert 0 < docs.count() <= 3 * rows
    assert docs.where(F.col("n_tokens") > 0).count() == docs.count()


def test_stages_on_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0
