"""Toxicity: a classifier chain over document labels.

Categories are predicted in a fixed order by linear models on the words that a text holds; each later model also gets
the logits of the earlier ones. For training these are out-of-fold predictions, so that a later model sees the errors
that it will see in use. Words are weighted by their smoothed log ratio of classes, and a logistic model is fitted on
these. Training takes a bounded sample of labelled rows (MAX_TRAIN, the first in a fixed pseudo-random order of ids)
on the driver; scoring covers every row, and broadcasts weights of fixed size.

Defined results: null text has no words and gets the model's base rate; without labels, or with labels of one class,
every probability is the (smoothed) base rate; rows are scored singly; labels of unknown or null ids are left out before the
sample is cut; repeated rows of an id and text are one for training, with the larger of different labels; a text with one null
label trains the other category's model only; texts of any length are scored whole; an empty table gives an empty result; only
doc_id, text and the kept columns are read, so that others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows to train on, at most; slots of the hashed vocabulary; folds; fewest training texts that hold a used word.
MAX_TRAIN, SLOTS, FOLDS, LEAST_TEXTS = 20000, 1 << 20, 5, 4
#: Chain: category, label column, and the label's value that means the category.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
#: Words whose slots a worker keeps.
WORDS_KEPT = 1 << 18

_SPACES = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


class Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = slot = zlib.crc32(word) & (SLOTS - 1)
        return slot


def words_in(text: str | None, slots: Slots) -> np.ndarray:
    """Slots of the distinct words of a whole text: ASCII lower case, cut at ASCII characters that are no letter or digit."""
    words = set((text or "").encode().lower().translate(_SPACES).split())
    return np.unique(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Weights of words, of earlier logits, and the intercept."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, slots: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.words[slots], n) + (earlier @ self.earlier if earlier.shape[1] else 0) + self.bias


def fit(rows: np.ndarray, slots: np.ndarray, y: np.ndarray, earlier: np.ndarray, steps: int = 150, ridge: float = 2.0) -> Linear:
    """Logistic regression on words (as row and slot of each) scaled by their log ratio, and on earlier logits."""
    n = len(y)
    positive = float(y.sum())
    base = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if n == 0 or positive in (0, n):
        return Linear(np.zeros(SLOTS), np.zeros(earlier.shape[1]), base)
    texts = np.bincount(slots, minlength=SLOTS)
    with_word = np.bincount(slots, y[rows], SLOTS)
    ratio = np.log((with_word + 0.5) / (positive + 1)) - np.log((texts - with_word + 0.5) / (n - positive + 1))
    ratio[texts < LEAST_TEXTS] = 0
    use = np.flatnonzero(np.abs(ratio) > 1.0)
    place = np.full(SLOTS, -1)
    place[use] = np.arange(len(use))
    keep = place[slots] >= 0
    r, c = rows[keep], place[slots[keep]]
    v = ratio[use][c]
    k = len(use)
    scale = np.maximum(earlier.std(axis=0), 1e-6) if earlier.shape[1] else np.ones(0)
    dense = earlier / scale
    w, u, b = np.full(k, 0.3), np.zeros(earlier.shape[1]), base
    m1, m2 = np.zeros(k + len(u) + 1), np.zeros(k + len(u) + 1)
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(r, v * w[c], n) + dense @ u + b)
        e = (p - y) / n
        g = np.concatenate([np.bincount(c, v * e[r], k) + ridge * w / n, dense.T @ e + ridge * u / n, [e.sum()]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, u, b = w - step[:k], u - step[k:-1], b - step[-1]
    words = np.zeros(SLOTS)
    words[use] = ratio[use] * w
    return Linear(words, u / scale, float(b))


def _of(keep: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words (row and slot of each) of the kept texts, these numbered anew."""
    inside = keep[rows]
    return (np.cumsum(keep) - 1)[rows[inside]], slots[inside]


def fit_chain(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels, from the texts whose label is known (not NaN); later ones get out-of-fold logits of earlier ones."""
    n, k = labels.shape
    earlier, chain = np.zeros((n, 0)), []
    for j in range(k):
        known = ~np.isnan(labels[:, j])
        y = np.where(known, labels[:, j], 0.0)
        chain.append(fit(*_of(known, rows, slots), y[known], earlier[known]))
        if j + 1 < k:
            out = np.zeros(n)
            for f in range(FOLDS):
                held = folds == f
                use = known & ~held
                model = fit(*_of(use, rows, slots), y[use], earlier[use])
                mine = held[rows]
                out[held] = model.logits(rows[mine], slots[mine], n, earlier)[held]
            earlier = np.column_stack([earlier, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> list[Linear]:
    columns = list(dict.fromkeys(c for _, c, _ in chain))
    content = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")
    given = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in columns)).dropna("all", subset=columns)
    # one row an id and text, whatever repeats; only then the sample is cut, so that the driver gets no more than MAX_TRAIN texts
    every = docs.select("doc_id", content).join(given, "doc_id").groupBy("doc_id", "_h").agg(*(F.max(c).alias(c) for c in columns))
    sample = every.withColumn("_o", F.md5(F.col("doc_id").cast("string"))).orderBy("_o", "_h").limit(MAX_TRAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            words = [words_in(t.as_py(), slots).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.list_(pa.int32()))], names=["o", *columns, "w"])

    texts = docs.select("doc_id", content, "text").join(F.broadcast(sample), ["doc_id", "_h"])
    one = texts.groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.first("_o").alias("o"), *(F.first(c).alias(c) for c in columns))
    got = one.select("text", "o", *columns).mapInArrow(run, "o string, " + ", ".join(f"`{c}` int" for c in columns) + ", w array<int>").toArrow()
    order = np.array(sorted(range(len(got)), key=list(zip(got["o"].to_pylist(), got["w"].to_pylist())).__getitem__), int)
    got = got.take(pa.array(order, pa.int64())).combine_chunks()
    sizes = np.asarray(got["w"].combine_chunks().value_lengths().fill_null(0)).astype(int) if len(got) else np.zeros(0, int)
    rows = np.repeat(np.arange(len(got)), sizes)
    slots = np.asarray(got["w"].combine_chunks().flatten()).astype(int) if len(got) else np.zeros(0, int)
    values = {c: np.array([np.nan if v is None else v for v in got[c].to_pylist()], float) for c in columns}
    y = np.column_stack([np.where(np.isnan(values[c]), np.nan, values[c] == v) for _, c, v in chain]) if len(got) else np.zeros((0, len(chain)))
    folds = np.array([int(o[-6:], 16) % FOLDS for o in got["o"].to_pylist()], int)
    return fit_chain(rows, slots, y, folds)


def scored(docs: DataFrame, keep: list[str], models: list[Linear], chain=CHAIN) -> DataFrame:
    """The columns keep of docs (text) and p_<category> for each category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast([(m.words.astype(np.float32), m.earlier, m.bias) for m in models])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"p_{name} double" for name, _, _ in chain)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            logits = np.zeros((batch.num_rows, len(chain)))
            for i, text in enumerate(batch.column(0)):
                own = words_in(text.as_py(), slots)
                for j, (words, earlier, bias) in enumerate(shared.value):
                    logits[i, j] = float(words[own].sum(dtype=np.float64)) + float(logits[i, :j] @ earlier) + bias
            p = np.round(_sigmoid(logits), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(p[:, j]) for j in range(len(chain)))], names=[*keep, *(f"p_{name}" for name, _, _ in chain)])

    return docs.selectExpr("text AS _text", *(f"`{c}`" for c in keep)).mapInArrow(run, schema)
