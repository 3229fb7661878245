"""Cases in which an operator once did less than its whole job."""

import itertools
import textwrap

import numpy as np
import pyarrow as pa

from helixbin.llm import licenses, neardup

TEXTS = "doc_id long, text string"


def copies_of_one(n, words=400, edits=6):
    """A text and n copies of it, each with its own edits: similar to the text, but hardly to one another."""
    rng = np.random.default_rng(8)
    original = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = [" ".join(original)]
    for k in range(n):
        copy = list(original)
        for p in rng.choice(words // 10, edits, replace=False):
            copy[10 * p + int(rng.integers(0, 5))] = f"e{k}x{p}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_of_one_original(spark):
    texts = copies_of_one(400)
    frame = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(4)
    got = neardup.judged(frame, ["doc_id"]).collect()
    assert len(got) == len(texts) and {r.class_id for r in got} == {0}


def test_near_duplicates_in_full_buckets_without_an_original(spark):
    rng = np.random.default_rng(9)
    texts = copies_of_one(300)[1:]
    for t in texts[:100]:
        words = t.split()
        words[int(rng.integers(5, 390))] = "again"
        texts.append(" ".join(words))
    texts.append(texts[0] + " " + texts[0])  # weights over 1
    signed = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    sets = neardup._weighted(pa.array(texts))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(signed[i] & signed[j]) >= 0.75 * len(signed[i]) and neardup.probability_jaccard(sets[i], sets[j]) >= 0.8:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    frame = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.judged(frame, ["doc_id"]).collect()}
    assert len(set(got.values())) > 100 and got == {i: find(i) for i in range(len(texts))}


def test_wrapped_notices(spark):
    rows = []
    for k, (label, notice) in enumerate(licenses.TEMPLATES):
        for width, lead in ((70, " * "), (30, "# "), (12, "")):
            wrapped = "\n".join(lead + x for x in textwrap.wrap(notice, width, break_long_words=False))
            rows.append((len(rows), f"words before it\n{wrapped}\nand words after it", label))
    whole = "Copyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    rows.append((len(rows), whole, "mit-notice"))
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, want string"), ["doc_id", "want"]).collect()}
    for i, _, label in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1, rows[i]
    scattered = "permission\n" + "is hereby granted other words " * 30 + "\nfree of charge to any person\n" + "more of it " * 30 + "\nobtaining a copy of this software and associated"
    apart = licenses.scanned(spark.createDataFrame([(0, scattered)], "doc_id long, text string"), ["doc_id"]).first()
    assert (apart.labels, apart.score) == ("", 0)
