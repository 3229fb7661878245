"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every text becomes a vector of transformed statistics. For each language and source, and for each language and all texts, which steady
the estimates of small groups, concentration steps look for the three quarters of the rows whose covariance has the least
determinant; a document is rejected when its Mahalanobis distance from the estimate of its language and source is too
large, or when it fails a base rule.

A concentration step is one aggregation: rows are binned by their distance under the last estimate, sums and cross products are
added up by group and bin, and a running sum over the bounded number of bins of a group gives the estimate of its nearest three
quarters. No group's rows meet in one task, and every row counts. There are three starts (medians and quartiles, moments, spatial
signs); after two steps each group goes on with that of least determinant until no determinant falls any more.

An estimate from n rows is shrunk as if WEIGHT further rows had come from that of the next larger group, and all texts' as if WEIGHT
rows had come from PRIOR. So small groups need no switch; WEIGHT is nothing beside a large group's rows. Most texts repeat no line
and hold no symbol, so that the nearest rows of a large group can be all equal in a statistic; therefore the determinant is that of
the regularized estimate: a share RIDGE of the prior's covariance and the rest of the rows', at every group size.

Defined results: null text has no words and fails the base rules; null language or source is a group like
others; rows are judged singly, so repeated rows and repeated ids get equal verdicts; an empty table gives
an empty result; texts of any length are read whole, in chunks; other columns of the input pass through ``kept_rows`` unchanged, and
clashing names are moved aside because the statistics live in one struct column of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.llm.common import broadcast_if_small, byte_chunks, materialize, settled, sums_between

#: Fewest words of a document, and largest share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
#: Share of a group's rows that the MCD concentrates on, steps of all starts, most steps, and the fall of a log determinant that ends them.
SUPPORT, FIRST_STEPS, MOST_STEPS, TOLERANCE = 0.75, 2, 20, 1e-2
#: Rejection where a Gaussian of as many dimensions would lie farther out with this probability.
TAIL = 1e-6
#: Bins of distance in a concentration step: BIN_PER_E per factor e, clamped to BINS.
BINS, BIN_PER_E = 160, 8.0
#: Code points of a word that count for the spread of word lengths, so that a key or an address in a text is one long word only.
LONG_WORD = 20
#: Transformed statistics, and a usual centre and spread of each: what WEIGHT rows are assumed to have shown before any row is read.
#: They are round figures for prose in alphabetic languages: five-letter words, a mark to thirty letters, a capital to fifty, forty words a
#: line, no repeats, and for the four shares a spread of about a factor of two. Groups of some hundred rows override the centres.
PRIOR = {
    "word_length": (1.6, 0.1), "length_spread": (0.9, 0.15), "diversity": (0.95, 0.03), "marks": (-3.5, 0.4), "capitals": (-4.0, 0.5),
    "line_words": (3.7, 0.8), "symbols": (-4.6, 0.8), "digits": (-3.9, 0.8), "repeated_lines": (-3.0, 0.8), "repeated_words": (-3.0, 0.8),
}
#: Shares below which a text has hardly any symbols, digits, repeated lines or repeated words; they are added before the logarithm.
FEW = {"n_symbols": 0.01, "n_digits": 0.02, "n_dup_lines": 0.05, "n_repeat_words": 0.05}
#: Share of the prior's covariance in every estimate.
RIDGE = 0.1
WEIGHT = 30.0

_WS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_digits", "n_distinct", "capped", "capped2")
CHUNK = 1 << 20


def _by_lines_and_words(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, words inside three-word windows that occur twice or more, and distinct words."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return len(lines), dup, 0, len(set(words))
    seen = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return len(lines), dup, sum(covered), len(set(words))


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for every text."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    for lo, hi, data, offsets in byte_chunks(texts, CHUNK):
        word = ~_WS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        end = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum(word & ((data & 0xC0) != 0x80), out=points[1:])
        first = np.searchsorted(start, offsets)
        out["n_words"][lo:hi] = np.diff(first)
        out["word_chars"][lo:hi] = np.diff(points[offsets])
        capped = np.r_[0, np.minimum(points[end] - points[start], LONG_WORD)]
        out["capped"][lo:hi] = np.diff(np.cumsum(capped)[first])
        out["capped2"][lo:hi] = np.diff(np.cumsum(capped * capped)[first])
        for k, table in (("n_symbols", _SYMBOL), ("n_capitals", _UPPER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
            out[k][lo:hi] = sums_between(table[data], offsets)
        raw = data.tobytes()
        for i in range(hi - lo):
            for k, v in zip(("n_lines", "n_dup_lines", "n_repeat_words", "n_distinct"), _by_lines_and_words(raw[offsets[i] : offsets[i + 1]])):
                out[k][lo + i] = v
    return out


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and a struct column q of the counts; the text is read once, in bounded chunks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    carried = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            counts = text_counts(text)
            q = pa.StructArray.from_arrays([pa.array(counts[k]) for k in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [q], names=[*keep, "q"])

    fields = ", ".join(f"{k}: bigint" for k in COUNTS)
    return docs.select("text", *carried).mapInArrow(run, f"{schema + ', ' if keep else ''}q struct<{fields}>")


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (F.col(f"{q}.n_repeat_words") > MAX_REPEAT_SHARE * F.col(f"{q}.n_words"))


def statistics(q: str = "q") -> list[Column]:
    """The transformed statistics: logarithms of the mean and the spread of word lengths, of distinct words on the scale of all words, of
    the odds of marks and capitals among the characters, of the words of a line, and of the shares of symbols and digits among the
    characters, of repeated lines, and of words in repeated windows."""
    c = lambda k: F.col(f"{q}.{k}").cast("double")
    words = F.greatest(c("n_words"), F.lit(1.0))
    odds = lambda k: F.log((c(k) + 0.5) / (F.greatest(c("word_chars") - c(k), F.lit(0.0)) + 0.5))
    share = lambda k, of: F.log(c(k) / F.greatest(of, F.lit(1.0)) + FEW[k])
    mean = c("capped") / words
    return [
        F.log(F.greatest(c("word_chars"), F.lit(1.0)) / words),
        0.5 * F.log(F.greatest(c("capped2") / words - mean * mean, F.lit(0.0)) + 0.05),
        F.log(F.greatest(c("n_distinct"), F.lit(1.0))) / F.log(words + 1),
        odds("n_marks"),
        odds("n_capitals"),
        F.log(words / F.greatest(c("n_lines"), F.lit(1.0))),
        share("n_symbols", c("word_chars")),
        share("n_digits", c("word_chars")),
        share("n_dup_lines", c("n_lines")),
        share("n_repeat_words", c("n_words")),
    ]


def _even_chi2_cdf(x: float, dof: int) -> float:
    term, total = 1.0, 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - float(np.exp(-x / 2)) * total


@lru_cache(4096)
def chi2_quantile(share: float, dof: int) -> float:
    """The squared length that this share of Gaussian rows does not exceed (dof even)."""
    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _even_chi2_cdf(mid, dof) < share else (lo, mid)
    return lo


def consistency(p: int, support: float) -> float:
    """Factor that makes the covariance of the nearest share of Gaussian rows unbiased (p even)."""
    return 1.0 if support >= 1 else support / _even_chi2_cdf(chi2_quantile(support, p), p + 2)


P = len(PRIOR)
#: Squared Mahalanobis distance of the rejection.
CUTOFF2 = chi2_quantile(1 - TAIL, P)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_GROUP = "g struct<lang: string, source: string>"


def square(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((P, P))
    for (i, j), v in zip(_PAIRS, upper):
        out[i, j] = out[j, i] = v
    return out


def moments(n: float, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows from their sums and the sums of their products."""
    mean = np.asarray(s, float) / n
    return mean, square(np.asarray(c, float) / n) - np.outer(mean, mean)


def steadied(n: float, cov: np.ndarray, weight: float) -> np.ndarray:
    """The covariance of n rows together with weight rows of the prior, and RIDGE of the prior's."""
    prior = np.diag([spread**2 for _, spread in PRIOR.values()])
    return (1 - RIDGE) * (n * cov + weight * prior) / (n + weight) + RIDGE * prior


def whitening(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """W with squared distance |W (x - centre)|**2, and the logarithm of the determinant."""
    root = np.linalg.cholesky(cov)
    return np.linalg.inv(root), 2 * float(np.log(np.diag(root)).sum())


def _table(rows: list[list], like: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    kinds = {"start": pa.int32(), "n": pa.float64(), "det": pa.float64()}
    columns = [pa.array([r[k] for r in rows], kinds.get(name, pa.list_(pa.float64()))) for k, name in enumerate(names)]
    return pa.RecordBatch.from_arrays([like.column("g"), *columns], names=["g", *names])


def _estimated(sums: DataFrame) -> DataFrame:
    """(g, start, n, centre, cov, matrix, det) from (g, start, n, total, s, c): estimates of the n nearest of total rows."""
    names = ["start", "n", "centre", "cov", "matrix", "det"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, start, n, total, s, c in zip(*(batch.column(k).to_pylist() for k in ("g", "start", "n", "total", "s", "c"))):
                mean, cov = moments(n, s, c)
                # smaller groups are shrunk towards larger ones at the end
                cov = steadied(n, cov * consistency(P, round(n / total, 3)), WEIGHT if g["lang"] == g["source"] == "" else 0.0)
                matrix, det = whitening(cov)
                rows.append([start, float(total), mean.tolist(), [cov[i, j] for i, j in _PAIRS], matrix.ravel().tolist(), det])
            yield _table(rows, batch, names)

    return sums.mapInArrow(run, f"{_GROUP}, start int, n double, centre array<double>, cov array<double>, matrix array<double>, det double")


def _whitened(estimates: DataFrame) -> DataFrame:
    """(g, centre, matrix) from (g, centre, cov)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[centre, whitening(square(cov))[0].ravel().tolist()] for centre, cov in zip(batch.column("centre").to_pylist(), batch.column("cov").to_pylist())]
            yield _table(rows, batch, ["centre", "matrix"])

    return estimates.select("g", "centre", "cov").mapInArrow(run, f"{_GROUP}, centre array<double>, matrix array<double>")


def _distance2() -> Column:
    diff = [F.col("x")[j] - F.col("centre")[j] for j in range(P)]
    rows = [reduce(Column.__add__, (F.col("matrix")[i * P + j] * diff[j] for j in range(i + 1))) for i in range(P)]
    return reduce(Column.__add__, (r * r for r in rows))


def _distance2_of(x: Column) -> Column:
    """The same distance of an expression x, which is evaluated once, however a filter moves: written out, the statistics would stand there
    110 times, in code too long to be compiled."""
    diff = F.zip_with(x, F.col("centre"), lambda a, b: a - b)
    row = lambda d, i: reduce(Column.__add__, (F.col("matrix")[i * P + j] * d[j] for j in range(i + 1)))
    rows = F.transform(F.array(diff), lambda d: F.array(*(row(d, i) for i in range(P))))[0]
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + r * r)


def _sums(x: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS)).alias("c")]


def _tag(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def _group(lang: Column, source: Column) -> Column:
    return F.struct(lang.alias("lang"), source.alias("source"))


def grouped(rows: DataFrame) -> DataFrame:
    """(g, x): each row of rows (lang, source, x) in the group of its language and source, that of its language, and that of all."""
    every = [_group(_tag("lang"), _tag("source")), _group(_tag("lang"), F.lit("")), _group(F.lit(""), F.lit(""))]
    return rows.select(F.explode(F.array(*every)).alias("g"), "x")


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, n, centre, cov, matrix, det) of the three starts of each group of rows (g, x)."""
    x = [F.col("x")[i] for i in range(P)]
    quartiles = F.array(*(F.percentile_approx(v, [0.25, 0.5, 0.75], 200) for v in x))
    whole = materialize(rows.groupBy("g").agg(quartiles.alias("q"), *_sums(x)).withColumn("total", F.col("n")))
    middle = F.transform("q", lambda q: q[1])
    scale = F.transform("q", lambda q: F.greatest((q[2] - q[0]) / 1.349, F.lit(1e-6)))
    flat = F.array(*(F.col("n") * (F.col("mid")[i] * F.col("mid")[j] + (F.col("scale")[i] * F.col("scale")[j] if i == j else F.lit(0.0))) for i, j in _PAIRS))
    named = materialize(whole.select("g", "n", "total", "s", "c", middle.alias("mid"), scale.alias("scale")))
    by_quartiles = named.select("g", F.lit(0).alias("start"), "n", "total", F.transform("mid", lambda v: v * F.col("n")).alias("s"), flat.alias("c"))
    by_moments = named.select("g", F.lit(1).alias("start"), "n", "total", "s", "c")
    z = [(x[i] - F.col("mid")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.sqrt(F.greatest(reduce(Column.__add__, (v * v for v in z)), F.lit(1e-12)))
    signs = rows.join(broadcast_if_small(named.select("g", "mid", "scale")), "g").select("g", F.array(*(v / length for v in z)).alias("x"))
    signs = signs.groupBy("g").agg(*_sums(x)).select("g", "n", F.col("c").alias("u"))
    # the signs' covariance has trace 1: times P it is on the quartiles' scale
    spread = F.array(*(F.col("n") * F.col("mid")[i] * F.col("mid")[j] + P * F.col("u")[k] * F.col("scale")[i] * F.col("scale")[j] for k, (i, j) in enumerate(_PAIRS)))
    by_signs = signs.join(named.drop("n", "s", "c"), "g").select("g", F.lit(2).alias("start"), "n", "total", F.transform("mid", lambda v: v * F.col("n")).alias("s"), spread.alias("c"))
    return materialize(_estimated(by_quartiles.union(by_moments).union(by_signs)))


def _step(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimates of the nearest share of each group's rows under its last estimates."""
    by_bin = Window.partitionBy("g", "start").orderBy("bin")
    bin_ = F.least(F.greatest((BIN_PER_E * F.log(_distance2() + 1e-6) + BINS / 2).cast("int"), F.lit(0)), F.lit(BINS - 1))
    near = rows.join(broadcast_if_small(estimates.select("g", "start", "centre", "matrix")), "g").select("g", "start", "x", bin_.alias("bin"))
    bins = near.groupBy("g", "start", "bin").agg(*_sums([F.col("x")[i] for i in range(P)]))
    run = lambda name, k: F.array(*(F.sum(F.col(name)[i]).over(by_bin) for i in range(k)))
    total = F.sum("n").over(Window.partitionBy("g", "start"))
    upto = bins.select("g", "start", "bin", F.sum("n").over(by_bin).alias("n"), run("s", P).alias("s"), run("c", len(_PAIRS)).alias("c"), total.alias("total"))
    nearest = upto.where(F.col("n") >= SUPPORT * F.col("total")).groupBy("g", "start").agg(F.min_by(F.struct("n", "total", "s", "c"), "bin").alias("v"))
    return materialize(_estimated(nearest.select("g", "start", "v.*")))


def concentrated(rows: DataFrame) -> DataFrame:
    """(g, n, centre, cov) of each group of rows (g, x): the estimate of least determinant."""
    last = _starts(rows)
    for k in range(MOST_STEPS):
        new = _step(rows, last)
        if k + 1 < FIRST_STEPS:
            last = new
            continue
        if k + 1 == FIRST_STEPS:
            best = new.groupBy("g").agg(F.min_by(F.struct("start", "n", "centre", "cov", "matrix", "det"), F.struct("det", "start")).alias("v"))
            last = materialize(best.select("g", "v.*"))
            continue
        before = last.select("g", F.struct("start", "n", "centre", "cov", "matrix", "det").alias("b"))
        both = new.join(before, "g").withColumn("falls", F.col("det") < F.col("b.det") - TOLERANCE)
        chosen = F.when(F.col("falls"), F.struct("start", "n", "centre", "cov", "matrix", "det")).otherwise(F.col("b"))
        both = materialize(both.select("g", "falls", chosen.alias("v")))
        last = both.select("g", "v.*")
        if not both.where("falls").limit(1).count():
            break
    return last.select("g", "n", "centre", "cov")


@settled
def estimates_of(rows: DataFrame) -> DataFrame:
    """(g, centre, matrix) of each language and source of rows (lang, source, x): its MCD estimate, shrunk towards its language's,
    and that towards that of all rows."""
    found = concentrated(grouped(rows))
    shrunk = lambda name: F.zip_with(F.col(name), F.col(f"p.{name}"), lambda a, b: (F.col("n") * a + WEIGHT * b) / (F.col("n") + WEIGHT)).alias(name)
    parent = lambda df, *by: df.select(*(F.col(f"g.{b}").alias(f"_{b}") for b in by), F.struct("centre", "cov").alias("p"))
    whole = found.where("g.lang = ''")
    langs = found.where("g.lang <> '' AND g.source = ''").withColumn("_source", F.lit(""))
    langs = langs.join(F.broadcast(parent(whole, "source")), "_source").select("g", "n", shrunk("centre"), shrunk("cov"))  # one row
    pairs = found.where("g.source <> ''").withColumn("_lang", F.col("g.lang"))
    pairs = pairs.join(parent(langs, "lang"), "_lang").select("g", "n", shrunk("centre"), shrunk("cov"))
    return _whitened(pairs)


def fit(rows: DataFrame) -> DataFrame:
    """The estimates, hinted for broadcast if they are few."""
    return broadcast_if_small(estimates_of(rows))


def judged(docs: DataFrame, keep: list[str], once: bool = True) -> DataFrame:
    """The columns keep, the counts q, base_failed, distance2 and kept, of every row of docs (text, lang, source).

    The rows with their counts are written to shared storage once, or if not once, counted again for the result, so that wide rows
    are not kept twice; the estimates read only their narrow columns, which are written in any case. Rows of a language and source without a text that passes the base rules have no
    distance.
    """
    carried = list(dict.fromkeys([*keep, "lang", "source"]))
    rows = with_counts(docs, carried)
    if once:
        rows = materialize(rows)
    narrow = materialize(rows.where(~base_failed()).select("lang", "source", F.array(*statistics()).alias("x")))
    params = fit(narrow).select("g.lang", "g.source", "centre", "matrix").toDF("_lang", "_source", "centre", "matrix")
    named = rows.withColumn("_lang", _tag("lang")).withColumn("_source", _tag("source"))
    out = named.join(params, ["_lang", "_source"], "left").withColumn("distance2", _distance2_of(F.array(*statistics())))
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("distance2") <= CUTOFF2, F.lit(True))
    return out.select(*keep, "q", failed.alias("base_failed"), F.round("distance2", 6).alias("distance2"), kept.alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    names = docs.columns
    moved = docs.toDF(*(n if n in ("text", "lang", "source") else f"_c{i}" for i, n in enumerate(names)))
    return judged(moved, moved.columns, once=False).where("kept").select(*moved.columns).toDF(*names)
