"""The classifier chain against a plain one, bounds of its sample, and odd labels."""

import hashlib
import re

import numpy as np
import pytest

from helixbin.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
TEXTS = "doc_id long, text string, p_toxic double, _h long, o string"


def corpus(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(words, 40), *["vile"] * (i % 4 == 0), *["junk"] * (i % 3 == 0)]), 0.5, 1, "o") for i in range(n)]
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, n, 2)]
    return rows, labels


def plain_fit(texts, y, earlier, steps=150, ridge=2.0):
    """A dense model: every word a column, gradients by matrix products."""
    n, positive = len(y), sum(y)
    base = np.log((positive + 0.5) / (n - positive + 0.5))
    if n == 0 or positive in (0, n):
        return {}, np.zeros(earlier.shape[1]), base
    vocabulary = sorted(set().union(*texts))
    x = np.array([[w in t for w in vocabulary] for t in texts], float)
    have, good = x.sum(0), x[np.array(y) == 1].sum(0)
    ratio = np.log((good + 0.5) / (positive + 1)) - np.log((have - good + 0.5) / (n - positive + 1))
    use = (have >= toxicity.LEAST_TEXTS) & (np.abs(ratio) > 1.0)
    x, ratio = x[:, use] * ratio[use], ratio[use]
    scale = np.maximum(earlier.std(0), 1e-6) if earlier.shape[1] else np.ones(0)
    x = np.column_stack([x, earlier / scale])
    w = np.r_[np.full(use.sum(), 0.3), np.zeros(earlier.shape[1]), base]
    m1 = m2 = np.zeros(len(w))
    for t in range(1, steps + 1):
        e = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) / n
        g = np.r_[x.T @ e + ridge * w[:-1] / n, e.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w - 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    k = int(use.sum())
    return {v: a for v, a in zip(np.array(vocabulary)[use], ratio * w[:k])}, w[k:-1] / scale, w[-1]


def plain_logits(model, texts, earlier):
    words, weights, bias = model
    return np.array([sum(words.get(w, 0.0) for w in t) for t in texts]) + earlier @ weights + bias


def plain_chain(texts, labels, ids):
    folds = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[-6:], 16) % toxicity.FOLDS for i in ids])
    earlier, chain = np.zeros((len(ids), 0)), []
    for j in range(labels.shape[1]):
        known = ~np.isnan(labels[:, j])
        pick = lambda mask: ([t for t, m in zip(texts, mask) if m], labels[mask, j], earlier[mask])
        chain.append(plain_fit(*pick(known)))
        if j + 1 < labels.shape[1]:
            out = np.zeros(len(ids))
            for f in range(toxicity.FOLDS):
                held = folds == f
                out[held] = plain_logits(plain_fit(*pick(known & ~held)), [t for t, h in zip(texts, held) if h], earlier[held])
            earlier = np.column_stack([earlier, out])
    return chain


def words(text):
    return set(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()))


@pytest.mark.parametrize("gaps", [False, True])
def test_chain_equals_a_plain_one(spark, gaps):
    rows, labels = corpus()
    if gaps:
        labels = [(i, None if i % 10 == 0 else q, None if i % 14 == 0 else t) for i, q, t in labels]
    frame = spark.createDataFrame(rows, TEXTS).repartition(3)
    models = toxicity.train(frame, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.scored(frame, ["doc_id"], models).collect()}
    own = [(i, q, t) for i, q, t in labels if q is not None or t is not None]
    texts = {r[0]: words(r[1]) for r in rows}
    y = np.array([[np.nan if q is None else q == 0, np.nan if t is None else t == 1] for _, q, t in own], float)
    chain = plain_chain([texts[i] for i, *_ in own], y, [i for i, *_ in own])
    every, earlier = [texts[r[0]] for r in rows], np.zeros((len(rows), 0))
    for j, model in enumerate(chain):
        z = plain_logits(model, every, earlier)
        want = 1 / (1 + np.exp(-z))
        assert np.allclose([got[r[0]][j] for r in rows], want, atol=2e-4)
        earlier = np.column_stack([earlier, z])
    held = [r[0] for r in rows if r[0] % 2]
    assert np.mean([(got[i][1] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97


def test_sample_is_bounded_after_the_join(spark, monkeypatch):
    """Repeated rows, ids and labels, and labels without a text: at most MAX_TRAIN texts reach the driver."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 20)
    rows, labels = corpus(60)
    frame = spark.createDataFrame(rows + [rows[0]] * 500 + [(0, f"other {k}", 0.5, 1, "o") for k in range(100)], TEXTS)
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, slots, y, folds: seen.append(len(y)) or [toxicity.Linear(np.zeros(toxicity.SLOTS), np.zeros(j), 0.0) for j in range(2)])
    toxicity.train(frame, spark.createDataFrame(labels * 3 + [(10_000 + k, 1, 1) for k in range(500)], LABELS))
    assert seen == [20]


def test_odd_labels(spark):
    rows, labels = corpus(80)
    frame = spark.createDataFrame(rows, TEXTS)
    one = toxicity.train(frame, spark.createDataFrame(labels, LABELS))
    odd = labels + labels[:9] + [(None, 0, 1), (5555, 0, 1), (3, None, None)]
    two = toxicity.train(frame, spark.createDataFrame(odd, LABELS).repartition(5))
    for a, b in zip(one, two):
        assert np.allclose(a.words, b.words) and np.allclose(a.earlier, b.earlier) and a.bias == pytest.approx(b.bias)
