"""Direct terminal repeats: sequences whose head and tail align are complete genomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbin.sources.store import materialize


def exact_repeats(contigs: DataFrame, longest: int = 60, shortest: int = 10) -> DataFrame:
    """(contig, n): the largest n over shortest, up to longest, for which the first and last n letters are equal."""
    ends = contigs.select("contig", F.left("seq", F.lit(longest)).alias("head"), F.right("seq", F.lit(longest)).alias("tail"))
    # as rows: inside a lambda the optimizer would put the ends' expressions, and so compute them for every n
    each = ends.select("contig", "head", "tail", F.explode(F.sequence(F.lit(shortest + 1), F.lit(longest))).alias("n"))
    fits = each.where((F.col("n") <= F.length("head")) & (F.left("head", F.col("n")) == F.right("tail", F.col("n"))))
    return fits.groupBy("contig").agg(F.max("n").alias("n"))


def align(head: str, tail: str, match: int = 1, mismatch: int = -5, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, int, int, int, float]:
    """Best local alignment with affine gaps: (head start, head end, tail start, tail end, identity), ends inclusive."""
    a, b = np.frombuffer(head.encode(), np.uint8), np.frombuffer(tail.encode(), np.uint8)
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1))
    gap_a, gap_b = np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -np.inf)
    for d in range(2, n + m + 1):  # anti-diagonals: cells of one do not depend on each other
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        gap_a[i, j] = np.maximum(score[i - 1, j] - gap_open, gap_a[i - 1, j] - gap_extend)
        gap_b[i, j] = np.maximum(score[i, j - 1] - gap_open, gap_b[i, j - 1] - gap_extend)
        step = score[i - 1, j - 1] + np.where(a[i - 1] == b[j - 1], match, mismatch)
        score[i, j] = np.maximum.reduce([np.zeros(len(i)), step, gap_a[i, j], gap_b[i, j]])
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    end_a, end_b, same, columns, state = int(i) - 1, int(j) - 1, 0, 0, "m"
    while i > 0 and j > 0 and (state != "m" or score[i, j] > 0):
        if state == "m":
            if score[i, j] == gap_a[i, j]:
                state = "a"
            elif score[i, j] == gap_b[i, j]:
                state = "b"
            else:
                same += int(a[i - 1] == b[j - 1])
                columns += 1
                i, j = i - 1, j - 1
            continue
        columns += 1
        if state == "a":
            state = "m" if gap_a[i, j] == score[i - 1, j] - gap_open else "a"
            i -= 1
        else:
            state = "m" if gap_b[i, j] == score[i, j - 1] - gap_open else "b"
            j -= 1
    return int(i), end_a, int(j), end_b, same / columns if columns else 0.0


#: Cells of an anti-diagonal of a batch of alignments.
BATCH_CELLS = 1 << 15


def best_ends(heads: list[bytes], tails: list[bytes], match: int = 1, mismatch: int = -5, gap_open: int = 5, gap_extend: int = 2, trace: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the best local alignment of each pair ends, as ``align`` says; -1 where nothing matches. Pairs are aligned side by side, with
    two anti-diagonals kept, so that most pairs are known to fail without their alignment traced. ``trace`` gets, of each anti-diagonal, the flags by which ``traced``
    finds the way back."""
    a = np.zeros((max(map(len, heads)), len(heads)), np.uint8)
    b = np.full((max(map(len, tails)), len(tails)), 1, np.uint8)  # cells beyond a text match nothing and so lie below the best
    for k, (h, t) in enumerate(zip(heads, tails)):
        a[: len(h), k], b[: len(t), k] = np.frombuffer(h, np.uint8), np.frombuffer(t, np.uint8)
    (n, width), m, back = a.shape, len(b), b[::-1]
    small = max(n, m) * match + gap_open - mismatch < 1 << 14
    kind, low = (np.int16, -(1 << 14)) if small else (np.int64, -(1 << 60))
    score = [np.zeros((n + 1, width), kind) for _ in range(3)]
    gap_a, gap_b = ([np.full((n + 1, width), low, kind) for _ in range(2)] for _ in "ab")
    best, end_a, end_b = np.zeros(width, kind), np.zeros(width, np.int64), np.zeros(width, np.int64)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        now, before, earlier = score[d % 3], score[(d - 1) % 3], score[(d - 2) % 3]
        ga, gb = gap_a[d % 2], gap_b[d % 2]
        np.maximum(before[lo - 1 : hi - 1] - kind(gap_open), gap_a[(d - 1) % 2][lo - 1 : hi - 1] - kind(gap_extend), out=ga[lo:hi])
        np.maximum(before[lo:hi] - kind(gap_open), gap_b[(d - 1) % 2][lo:hi] - kind(gap_extend), out=gb[lo:hi])
        step = (a[lo - 1 : hi - 1] == back[m - d + lo : m - d + hi]).astype(kind)
        step *= kind(match - mismatch)
        step += kind(mismatch)
        step += earlier[lo - 1 : hi - 1]
        np.maximum(step, 0, out=step)
        np.maximum(step, ga[lo:hi], out=step)
        np.maximum(step, gb[lo:hi], out=now[lo:hi])
        if trace is not None:
            flags = (now[lo:hi] == ga[lo:hi]).astype(np.uint8)
            for bit, holds in ((2, now[lo:hi] == gb[lo:hi]), (4, now[lo:hi] > 0), (8, ga[lo:hi] == before[lo - 1 : hi - 1] - kind(gap_open)), (16, gb[lo:hi] == before[lo:hi] - kind(gap_open))):
                flags |= holds.astype(np.uint8) * np.uint8(bit)
            trace.append(flags)
        top = now[lo:hi].max(axis=0)
        for k in np.flatnonzero((top >= best) & (top > 0)):
            i = lo + int(np.argmax(now[lo:hi, k]))
            if top[k] > best[k] or i < end_a[k]:  # of equal scores the first head end counts, then the first tail end
                best[k], end_a[k], end_b[k] = top[k], i, d - i
    return end_a - 1, end_b - 1


def traced(heads: list[bytes], tails: list[bytes]) -> list[tuple[int, int, int, int, float]]:
    """What ``align`` gives for each pair, of pairs aligned side by side."""
    trace: list[np.ndarray] = []
    end_a, end_b = best_ends(heads, tails, trace=trace)
    m, out = max(map(len, tails)), []
    for k, (a, b, last_a, last_b) in enumerate(zip(heads, tails, end_a.tolist(), end_b.tolist())):
        i, j, same, columns, state = last_a + 1, last_b + 1, 0, 0, 0  # the state is 0 on matches, else the flag of the gap
        while i > 0 and j > 0:
            flags = trace[i + j - 2][i - max(1, i + j - m), k]
            if not state:
                if not flags & 4:
                    break
                state = 1 if flags & 1 else 2 if flags & 2 else 0
                if not state:
                    same += a[i - 1] == b[j - 1]
                    columns, i, j = columns + 1, i - 1, j - 1
                continue
            columns += 1
            if state == 1:
                state, i = 0 if flags & 8 else 1, i - 1
            else:
                state, j = 0 if flags & 16 else 2, j - 1
        out.append((i, last_a, j, last_b, same / columns if columns else 0.0))
    return out


def seeded(ends: DataFrame, min_size: int = 10, min_identity: float = 0.95, match: int = 1, mismatch: int = -5, gap_open: int = 5) -> DataFrame:
    """Rows (head, tail) that can pass, by conditions that every accepted alignment meets; most others go before any is aligned.

    An accepted alignment begins at the head's first letter and ends at the tail's last. Its part before the first column that is no match
    must score more than 0, or the best local alignment would begin after it; such a column costs at least
    min(-mismatch, gap_open), so it is preceded by a run of ``run`` matches: the head's first ``run`` letters stand in the tail. In
    the same way it is followed by such a run: a shorter one adds no score, and of equal scores the earlier end counts. So the
    tail's last ``run`` letters stand in the head. With n columns over min_size, of which at most (1 - min_identity) n are no matches, its
    longest run of matches has at least ``seed`` letters: head and tail share a word of that length."""
    run = min(-mismatch, gap_open) // match + 1
    # past 1 / (1 - min_identity)**2 columns the bound no longer falls below its limit
    bound = lambda n: -(-(n - int((1 - min_identity) * n + 1e-9)) // (int((1 - min_identity) * n + 1e-9) + 1))
    seed = min(bound(n) for n in range(min_size + 1, min_size + 2 + int(2 / max(1 - min_identity, 1e-3)) ** 2))
    run = min(run, seed)
    first = F.instr(F.col("tail"), F.left("head", F.lit(run))) > 0
    last = F.instr(F.col("head"), F.right("tail", F.lit(run))) > 0
    near = ends.where((F.length("head") > min_size) & (F.length("tail") > min_size) & first & last)
    words = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (seed - 1)), lambda i: F.substring(F.col(c), i, F.lit(seed)))
    return near.where((F.least(F.length("head"), F.length("tail")) >= seed) & F.arrays_overlap(words("head"), words("tail")))


def terminal_repeats(contigs: DataFrame, min_size: int = 10, max_size: int = 300, min_identity: float = 0.95, seeds: bool = True) -> DataFrame:
    """(contig, head_start, head_end, tail_start, tail_end), ends exclusive, of contigs whose first and last max_size letters
    align over more than min_size letters, from the first letter of the head to the last of the tail."""
    ends = contigs.select("contig", F.length("seq").alias("n"), F.substring("seq", 1, max_size).alias("head"), F.right("seq", F.lit(max_size)).alias("tail"))
    kind = contigs.schema["contig"].dataType.simpleString()
    # written, or else the optimizer would put the sequence's expressions into the conditions' lambdas, and so compute it for every word;
    # the ends are narrow, and few files must not mean few tasks
    ends = materialize(ends.repartition(max(1, int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    if seeds:  # without them the result is the same
        ends = seeded(ends, min_size, min_identity)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, pairs = [], [r for r in frame.itertuples(index=False, name=None) if r[2]]
            size = max(1, BATCH_CELLS // max(1, max_size))
            parts = lambda rs: [(rs[i : i + size], *([r[k].encode() for r in rs[i : i + size]] for k in (2, 3))) for i in range(0, len(rs), size)]
            pairs = [r for rs, heads, tails in parts(pairs) for r, end in zip(rs, best_ends(heads, tails)[1]) if end == len(r[3]) - 1]
            for (c, n, head, tail), (s, e, ts, te, identity) in (x for rs, heads, tails in parts(pairs) for x in zip(rs, traced(heads, tails))):
                if e - s + 1 > min_size and identity >= min_identity and s == 0 and te == len(tail) - 1:
                    at = n - len(tail)
                    rows.append((c, s, e + 1, at + ts, at + te + 1))
            yield pd.DataFrame(rows, columns=["contig", "head_start", "head_end", "tail_start", "tail_end"])

    return ends.mapInPandas(run, f"contig {kind}, head_start bigint, head_end bigint, tail_start bigint, tail_end bigint")
