"""Outliers: a planted one for each statistic, and the estimate against concentration steps from many random starts in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.llm import quality
from helixbin.llm.common import materialize

TEXTS = "doc_id long, text string, lang string, source string"


def prose(rng, words):
    """Lines of 5 to 60 words, some capitals and marks."""
    out = []
    for _ in range(int(rng.integers(6, 20))):
        line = list(rng.choice(words, int(rng.integers(5, 60))))
        line[0] = line[0].capitalize()
        out.append(" ".join(w + ("," if rng.random() < 0.1 else "") for w in line) + ".")
    return "\n".join(out)


def longer(text, rng):
    return " ".join(w * 3 for w in text.split(" "))


def uneven(text, rng):
    return " ".join(w[:1] if k % 2 else w * 3 for k, w in enumerate(text.split(" ")))


def few_words(text, rng):
    own = text.split()[:14]
    return "\n".join(" ".join(rng.choice(own, len(line.split()))) for line in text.split("\n"))


def marked(text, rng):
    return text.replace(" ", "!? ")


def capitals(text, rng):
    return text.upper()


def one_word_lines(text, rng):
    return text.replace(" ", "\n")


def symbols(text, rng):
    return " ".join(w + " ###" * (k % 4 == 3) for k, w in enumerate(text.split(" ")))


def digits(text, rng):
    return " ".join(w if k % 3 else str(rng.integers(10000, 99999)) for k, w in enumerate(text.split(" ")))


def repeated_lines(text, rng):
    lines = text.split("\n")
    return "\n".join(lines + lines[: len(lines) // 3])


def spam_lines(text, rng):
    return "\n".join(x + "\nbuy now" * (k % 2) for k, x in enumerate(text.split("\n")))


def phrases(text, rng):
    words = text.split(" ")
    return " ".join(w + " click here to read more" * (k % 9 == 8) for k, w in enumerate(words))


@pytest.fixture(scope="module")
def clean():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(3000)]
    return [prose(rng, words) for _ in range(600)]


PLANTED = [longer, uneven, few_words, marked, capitals, one_word_lines, symbols, digits, repeated_lines, spam_lines, phrases]


def test_each_statistic_rejects_its_outliers(spark, clean):
    rng = np.random.default_rng(4)
    rows = [(k, t, "en", "a") for k, t in enumerate(clean)]
    for g, change in enumerate(PLANTED):
        rows += [(10_000 + 100 * g + k, change(clean[int(i)], rng), "en", "a") for k, i in enumerate(rng.choice(600, 6, replace=False))]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, TEXTS), ["doc_id"]).collect()}
    assert np.mean([got[k].kept for k in range(600)]) >= 0.99
    for g, change in enumerate(PLANTED):
        own = [got[10_000 + 100 * g + k] for k in range(6)]
        assert sum(not r.kept for r in own) >= 5, change.__name__
    judged_by_distance = [r for i, r in got.items() if i >= 10_000 and not r.base_failed]
    assert len(judged_by_distance) >= 6 * (len(PLANTED) - 1)


def plain_mcd(x, starts=300, seed=0):
    """The least determinant of regularized concentration steps over three quarters of the rows, from random small starts."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    h = int(np.ceil(quality.SUPPORT * n))
    best = (np.inf, None, None)
    for _ in range(starts):
        own = rng.choice(n, p + 1, replace=False)
        last = np.inf
        while True:
            share = 1.0 if len(own) < h else quality.SUPPORT
            cov = quality.steadied(len(own), np.cov(x[own].T, bias=True) * quality.consistency(p, share), quality.WEIGHT)
            centre, det = x[own].mean(0), np.linalg.slogdet(cov)[1]
            if len(own) == h and det >= last - 1e-6:
                break
            last = det if len(own) == h else np.inf
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            own = np.argsort(d, kind="stable")[:h]
        best = min(best, (det, tuple(centre), cov.tolist()))
    return best[0], np.array(best[1]), np.array(best[2])


def test_estimate_against_many_random_starts(spark):
    rng = np.random.default_rng(6)
    centre = np.array([c for c, _ in quality.PRIOR.values()])
    spread = np.array([s for _, s in quality.PRIOR.values()])
    mix = np.eye(quality.P) + 0.3 * np.triu(rng.normal(size=(quality.P, quality.P)), 1)
    x = centre + spread * (rng.normal(size=(500, quality.P)) @ mix)
    x[:60] += spread * 9  # an outlying cloud
    frame = spark.createDataFrame([("=en", "=a", r.tolist()) for r in x], "lang string, source string, x array<double>")
    rows = materialize(frame.select(F.struct(F.lit("").alias("lang"), F.lit("").alias("source")).alias("g"), "x"))
    got = quality.concentrated(rows).collect()
    assert len(got) == 1
    det, middle, cov = plain_mcd(x)
    found = quality.square(np.array(got[0]["cov"]))
    # distances are binned in steps of an eighth of a factor e, so that a few rows more than three quarters take part
    assert np.linalg.slogdet(found)[1] <= det + 0.35
    assert np.abs((np.array(got[0]["centre"]) - middle) / spread).max() < 0.15
    assert 0.7 < (np.diag(found) / np.diag(cov)).min() and (np.diag(found) / np.diag(cov)).max() < 1.4
    assert np.abs((np.array(got[0]["centre"]) - centre) / spread).max() < 0.4  # the cloud did not draw it


def test_few_and_equal_texts(spark, clean):
    """Tables of one text, of equal texts, and groups of one: nothing is an outlier of itself."""
    for texts in ([clean[0]], [clean[0]] * 40, clean[:3]):
        rows = [(k, t, None if k % 2 else "en", f"s{k}") for k, t in enumerate(texts)]
        got = quality.judged(spark.createDataFrame(rows, TEXTS), ["doc_id"]).collect()
        assert len(got) == len(texts) and all(r.kept for r in got)


def test_the_verdict_is_short_code(spark, clean):
    """The filter of kept rows once held the statistics 110 times, and its code was too long to be compiled."""
    frame = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(clean[:60])], TEXTS)
    plan = quality.kept_rows(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ln(") < 100
    rng = np.random.default_rng(8)
    rows = [(rng.normal(size=quality.P).tolist(), rng.normal(size=quality.P).tolist(), rng.normal(size=quality.P**2).tolist()) for _ in range(20)] + [([0.0] * quality.P, None, None)]
    both = spark.createDataFrame(rows, "x array<double>, centre array<double>, matrix array<double>")
    for r in both.select(quality._distance2().alias("a"), quality._distance2_of(F.col("x")).alias("b")).collect():
        assert r.a == r.b
