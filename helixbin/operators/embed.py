"""Latent pass: fragments of every contig through the network's trunk."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbin.operators.network import Model

_CODE = np.full(256, -1, np.int64)
_CODE[[65, 67, 71, 84]] = range(4)


def kmer_index(k: int, canonical: bool = True) -> np.ndarray:
    """Column of every k-mer code (A, C, G, T are 0 to 3): classes with the reverse complement are numbered by their least code."""
    codes = np.arange(4**k)
    if not canonical:
        return codes
    digits = np.stack([(codes >> (2 * i)) & 3 for i in range(k)])
    reverse = sum((3 - digits[i]) << (2 * (k - 1 - i)) for i in range(k))
    least = np.minimum(codes, reverse)
    return np.unique(least, return_inverse=True)[1]


def kmer_vector(seq: str, k: int, index: np.ndarray) -> np.ndarray:
    """Counts by column; windows with other letters are dropped."""
    code = _CODE[np.frombuffer(seq.encode(), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(int(index.max()) + 1, np.float32)
    total, valid = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        total = total * 4 + code[i : i + n]
        valid &= code[i : i + n] >= 0
    return np.bincount(index[total[valid]], minlength=int(index.max()) + 1).astype(np.float32)


def window_means(depth: np.ndarray, width: int, step: int) -> np.ndarray:
    """Means over the last axis of windows of width, every step."""
    sums = np.concatenate([np.zeros((*depth.shape[:-1], 1)), np.cumsum(depth, axis=-1, dtype=np.float64)], axis=-1)
    return ((sums[..., width:] - sums[..., :-width]) / width)[..., ::step]


def latents(contigs: DataFrame, model: Model, coverage: DataFrame | None = None, n_frags: int = 30, frag_len: int = 1024, min_length: int = 2048, k: int = 4, canonical: bool = True, width: int = 64, step: int = 32, skip: DataFrame | None = None) -> DataFrame:
    """(feature, contig, frag, vec) of contigs (contig, seq) of min_length or more, for the model's features.

    coverage has (contig, depth ARRAY<ARRAY>) with a row a sample; skip has contigs to leave out. A worker handles a contig at
    a time, so memory is bounded by the longest one; the weights are broadcast, their size is the network's."""
    rows = contigs.where(F.length("seq") >= max(min_length, frag_len))
    if skip is not None:
        rows = rows.join(skip.select("contig").distinct(), "contig", "left_anti")
    if coverage is not None:
        rows = rows.join(coverage, "contig")
    else:
        rows = rows.withColumn("depth", F.lit(None).cast("array<array<double>>"))
    shared = contigs.sparkSession.sparkContext.broadcast(model)
    kind = contigs.schema["contig"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, index = shared.value, kmer_index(k, canonical)
        for frame in frames:
            for contig, seq, depth in frame[["contig", "seq", "depth"]].itertuples(index=False):
                every = int((len(seq) - frag_len) / n_frags)
                starts = [every * i for i in range(n_frags)]
                out = []
                for name, branch in net.branches.items():
                    if branch.convolves:
                        cover = np.stack([np.asarray(d, float) for d in depth])
                        x = np.stack([window_means(cover[:, s : s + frag_len], width, step) for s in starts])
                    else:
                        x = np.stack([kmer_vector(seq[s : s + frag_len], k, index) for s in starts])
                    vecs = net.latent(name, x).astype(np.float32)
                    out += [(name, contig, i, v.tolist()) for i, v in enumerate(vecs)]
                yield pd.DataFrame(out, columns=["feature", "contig", "frag", "vec"])

    return rows.select("contig", "seq", "depth").mapInPandas(run, f"feature string, contig {kind}, frag int, vec array<float>")


def chunked(*iterators, size: int = 2):
    """Tuples of lists of size items of each iterator; nothing for no iterator."""
    if not iterators:
        return
    iterators = [iter(i) for i in iterators]
    while True:
        parts = [list(itertools.islice(i, size)) for i in iterators]
        if not all(parts):
            return
        yield tuple(parts)
