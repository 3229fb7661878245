"""Line dedup of large groups of near copies."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.llm import lines
from helixbin.llm.common import shared_dir


def edited(n, words, most, seed):
    """A line and n copies of it, each with its own new words, some with so many that they match few others."""
    rng = np.random.default_rng(seed)
    original = [f"w{i}" for i in range(words)]
    out = [" ".join(original)]
    for k in range(n):
        copy = list(original)
        for p in rng.choice(words, int(rng.integers(3, most)), replace=False):
            copy[p] = f"e{k}x{p}"
        out.append(" ".join(copy))
    return out


def removed(texts):
    sets = [set(t.split()) for t in texts]
    return {i for i, a in enumerate(sets) if any(len(a & b) >= 0.8 * len(a | b) - 1e-12 for b in sets[:i])}


def by_line(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in lines.judged(frame, ["doc_id"]).collect() if r.n_removed}


def test_near_copies_are_settled_by_leaders(spark, monkeypatch):
    """Copies whose rarest keys are their own edits once met no leader, so that each was compared with all before it."""
    texts = edited(200, 80, 8, 1)
    left = []

    def partners(sets, settled):
        left.append(sets.count() - settled.count())
        return whole(sets, settled)

    whole = lines._partners
    monkeypatch.setattr(lines, "_partners", partners)
    want = removed(texts)
    assert by_line(spark, texts) == want and len(want) == 200
    assert left[0] < 20


@pytest.mark.parametrize("hot", [2, 150, 1000])
def test_frequent_words_and_copies_near_the_threshold(spark, monkeypatch, hot):
    """Pairs of frequent tokens: a pair of lines meets at the first two tokens that it shares, and none is lost."""
    monkeypatch.setattr(lines, "HOT", hot)
    texts = edited(120, 60, 14, 2) + edited(60, 100, 30, 3)
    want = removed(texts)
    assert by_line(spark, texts) == want and 20 < len(want) < len(texts) - 20


def test_pairs_meet_once(spark, monkeypatch):
    """Two sets of frequent tokens were joined at each pair of tokens that they share."""
    monkeypatch.setattr(lines, "HOT", 2)
    made = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.distinct", lambda df: made.append(df.count()) or df.dropDuplicates())
    texts = [" ".join([f"w{i}" for i in range(60)] + [f"e{k}x{i}" for i in range(9)]) for k in range(30)]
    assert by_line(spark, texts) == removed(texts) == set()
    assert made and max(made) < 2 * 30 * 29 / 2, made


def test_keys_are_kept_once(spark, monkeypatch):
    """The table of all lines, with their keys, stayed beside that of the sets until the end."""
    kept = []

    def partners(sets, settled):
        root = shared_dir(spark).removeprefix("file:")
        tables = [t for t in glob.glob(f"{root}/helixbin-*") if t not in before]
        kept.append(sum("keys" in spark.read.parquet(f"file:{t}").columns for t in tables))
        return whole(sets, settled)

    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/helixbin-*"))
    whole = lines._partners
    monkeypatch.setattr(lines, "_partners", partners)
    texts = edited(40, 40, 6, 5)
    assert by_line(spark, texts) == removed(texts)
    assert kept == [1]


def test_tokens_hold_no_null(spark):
    """Elements that may be null were sorted as objects."""
    frame = spark.createDataFrame([(["a", "b", "a"], [0] * lines.BUCKETS)], "w array<string>, places array<long>")
    k = frame.select(lines.tokens(F.col("w"), F.col("places")).alias("k"))
    assert not k.schema["k"].dataType.containsNull and len(k.first().k) == 2


@pytest.mark.parametrize("parts", [1, 3])
def test_partners_are_compared_part_by_part(spark, monkeypatch, parts):
    """The entries of all keys lay on disk at once."""
    monkeypatch.setattr(lines, "PARTS", parts, raising=False)
    monkeypatch.setattr(lines, "LEADERS", 0)  # leave more to compare with all
    entries = []

    def partners(sets, settled):
        counted = [sets.select(F.explode(lines._of_part("keys", k)).alias("e")) for k in range(parts)]
        entries.append(([c.count() for c in counted], sets.select(F.explode("keys")).count()))
        pairs = whole(sets, settled)
        assert pairs.count() == pairs.dropDuplicates().count()
        return pairs

    whole = lines._partners
    monkeypatch.setattr(lines, "_partners", partners)
    texts = edited(60, 60, 14, 7) + edited(40, 12, 6, 8)
    assert by_line(spark, texts) == removed(texts)
    (each, total), = entries
    assert sum(each) == total and max(each) < 1.5 * total / parts


def test_keys_of_a_line_do_not_grow_with_the_corpus(spark, monkeypatch):
    """A fixed bound of frequent words made nearly all tokens of a large corpus frequent, and these are joined in pairs."""
    monkeypatch.setattr(lines, "HOT", 30)
    monkeypatch.setattr(lines, "WORDS", 8000, raising=False)
    keys = []
    whole = lines._partners
    monkeypatch.setattr(lines, "_partners", lambda sets, settled: keys.append(sets.agg(F.avg(F.size("keys"))).first()[0]) or whole(sets, settled))
    for n in (200, 1600):
        rng = np.random.default_rng(4)
        by_line(spark, [" ".join(f"w{i}" for i in rng.integers(0, 1000, 40)) for _ in range(n)])
    assert keys[1] < 1.5 * keys[0], keys


def test_rare_words_stay_rare(spark):
    """Words were counted in so few buckets that a rare one often shared its bucket with others."""
    n = 300_000
    docs = spark.range(60).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n // 60 - 1)), lambda i: F.concat(F.lit("w"), (F.col("id") * (n // 60) + i).cast("string"))), " ").alias("text"))
    places = lines.rarity(docs)
    word = docs.select(F.explode(F.split("text", " ")).alias("w"))
    rare = word.select(F.array("w").alias("w"), places.scalar().alias("p")).select(lines.tokens(F.col("w"), F.col("p"))[0].alias("t")).where(F.shiftright("t", 56) == 0).count()
    assert rare > 0.9 * n


@pytest.mark.parametrize("most", [-1, 400_000])
def test_texts_are_shuffled_in_parts(spark, monkeypatch, most):
    """All texts were shuffled at once where too many lines were wanted for a broadcast."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
    shares = []
    whole = lines._set_words
    monkeypatch.setattr(lines, "_set_words", lambda rows, by_row: shares.append(rows.count()) or whole(rows, by_row))
    texts = edited(150, 40, 12, 6)
    assert by_line(spark, texts) == removed(texts)
    assert max(shares) <= (len(texts) if most else len(texts) / 2)
