"""Sequence expressions: cleaning, k-mers, averaging windows and fragment layouts; JVM-side but for counts of short k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(seq: Column) -> Column:
    """Upper case without N."""
    return F.replace(F.upper(seq), F.lit("N"), F.lit(""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_total(k: int, canonical: bool = True) -> int:
    """Number of k-mers, or of classes of a k-mer and its reverse complement; palindromes are their own class."""
    palindromes = 4 ** (k // 2) if k % 2 == 0 else 0
    return (4**k - palindromes) // 2 + palindromes if canonical else 4**k


def kmers(df: DataFrame, keys: list[str], k: int = 4, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(keys, kmer) for every window of k letters; windows with letters other than A, C, G, T are dropped."""
    # a lookahead finds every overlapping window in one pass; substring() would count letters from the start each time
    windows = F.regexp_extract_all(F.col(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    out = df.select(*keys, F.explode(windows).alias("kmer"))
    return out.withColumn("kmer", F.least("kmer", reverse_complement(F.col("kmer")))) if canonical else out


#: Longest k-mers that are counted in arrays of 4**k numbers a sequence or batch; longer ones are exploded.
LONGEST_COUNTED = 8


#: Letters that are counted at a time (one sequence at least), and counted sequences that are written out at a time: they bound a worker's memory.
CHUNK_LETTERS, ROWS_OUT = 1 << 18, 256


def _names(k: int) -> list[str]:
    return ["".join("ACGT"[(c >> 2 * (k - 1 - i)) & 3] for i in range(k)) for c in range(4**k)]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings or bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _batch_counts(k: int, canonical: bool, by_row: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts of each sequence of a batch, as codes (two bytes each) and counts (eight), with the keys beside them; or those of some
    sequences in all. Windows do not cross sequences."""
    value = np.full(256, -1, np.int32)
    value[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    name = _names(k)
    least = np.arange(4**k)
    if canonical:
        complement = str.maketrans("ACGT", "TGCA")
        code = {n: c for c, n in enumerate(name)}
        least = np.array([min(c, code[n.translate(complement)[::-1]]) for c, n in enumerate(name)])
    names = pa.array(name)

    def counted(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys row * 4**k + code, or codes only, and their counts."""
        n = len(raw) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters, total, good = value[raw], np.zeros(n, np.int32), np.ones(n, bool)
        for i in range(k):
            total = total * 4 + letters[i : i + n]
            good &= letters[i : i + n] >= 0
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        good &= row[:n] == row[k - 1 :]
        return np.unique((row[:n][good] if by_row else 0) * 4**k + least[total[good]], return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _binary(batch.column(batch.num_columns - 1))
            hi = 0
            while hi < len(batch):
                lo, hi = hi, max(hi + 1, int(np.searchsorted(offsets, offsets[hi] + CHUNK_LETTERS, "right")) - 1)
                key, count = counted(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if not by_row:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(key)), pa.array(count)], ["kmer", "n"])
                    continue
                rows, first = np.unique(key // 4**k, return_index=True)
                ends = [*first[1:].tolist(), len(key)]
                codes, counts = (key % 4**k).astype("<u2"), count.astype("<i8")
                packed = [pa.array([x[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()) for x in (codes, counts)]
                kept = [batch.column(i).take(pa.array(lo + rows)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *packed], [*batch.schema.names[:-1], "codes", "counts"])

    return run


def _summed(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keys, kmer, n) from rows (keys, codes, counts) in order of the keys; the last key of a batch waits for the next one, as one row."""
    names = pa.array(_names(k))

    def groups(table: pa.Table) -> np.ndarray:
        """The number of each row's key among those of the table."""
        new = np.zeros(len(table), bool)
        for column in table.columns[:-2]:
            column = column.combine_chunks()
            left, right = column[:-1], column[1:]
            same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right)))
            new[1:] |= ~same.to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def merged(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a key, code, count), counts of a key's rows added."""
        codes, at = _binary(table.column("codes").combine_chunks())
        counts, _ = _binary(table.column("counts").combine_chunks())
        codes = codes[at[0] : at[-1]].view("<u2")
        counts = counts[at[0] * 4 : at[-1] * 4].view("<i8")
        key = np.repeat(group, np.diff(at) // 2) * 4**k + codes
        if len(group) and len(np.unique(group)) < len(group):
            order = np.argsort(key, kind="stable")
            key, starts = np.unique(key[order], return_index=True)
            counts = np.add.reduceat(counts[order], starts) if len(key) else counts
        row = np.unique(group, return_index=True)[1][np.searchsorted(np.unique(group), key // 4**k)]
        return row, key % 4**k, counts

    def listed(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        row, code, count = merged(table, group)
        kept = [c.combine_chunks().take(pa.array(row)) for c in table.columns[:-2]]
        return pa.RecordBatch.from_arrays([*kept, names.take(pa.array(code)), pa.array(count)], [*table.column_names[:-2], "kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_OUT):
                # a copy, so that offsets begin with the slice
                table = pa.Table.from_batches([batch.slice(lo, ROWS_OUT)])
                table = table.take(pa.array(range(len(table))))
                table = table if waiting is None else pa.concat_tables([waiting, table])
                group = groups(table)
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield listed(table.slice(0, last).take(pa.array(range(last))), group[:last])
                waiting, group = table.slice(last).take(pa.array(range(len(table) - last))), group[last:]
                if len(waiting) > 1:
                    _, code, count = merged(waiting, group)
                    packed = [pa.array([code.astype("<u2").tobytes()], waiting.schema.field("codes").type), pa.array([count.astype("<i8").tobytes()], waiting.schema.field("counts").type)]
                    waiting = pa.table([*(c.slice(0, 1) for c in waiting.columns[:-2]), *packed], waiting.column_names)
        if waiting is not None:
            yield listed(waiting, groups(waiting))

    return run


def kmer_counts(df: DataFrame, keys: list[str], k: int = 4, canonical: bool = True, seq: str = "seq") -> DataFrame:
    """(keys, kmer, n), counted in arrays some sequences at a time, so that no row is made a base. With keys the shuffle carries a row
    a sequence, and the rows of a key are added in order of the keys, so that no task holds a table of all its keys and k-mers."""
    if k > LONGEST_COUNTED:
        return kmers(df, keys, k, canonical, seq).groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return df.select(seq).mapInArrow(_batch_counts(k, canonical, False), "kmer string, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))
    own = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(o) for c, o in zip(keys, own)), F.col(seq).alias("seq"))
    kind = "".join(f"{o} {rows.schema[o].dataType.simpleString()}, " for o in own)
    parts = rows.mapInArrow(_batch_counts(k, canonical, True), kind + "codes binary, counts binary")
    sums = parts.repartition(*own).sortWithinPartitions(*own).mapInArrow(_summed(k), kind + "kmer string, n bigint")
    return sums.toDF(*keys, "kmer", "n")


def averaged(values: Column, width: int, step: int) -> Column:
    """Means of values[j*step : j*step+width], ceil((L-width+1)/step) of them; empty if there are fewer values than width."""
    n = F.size(values)
    last = F.greatest(((n - width) / step).cast("int"), F.lit(0))
    means = F.transform(F.sequence(F.lit(0), last), lambda j: F.aggregate(F.slice(values, j * step + 1, F.lit(width)), F.lit(0.0), lambda a, x: a + x) / width)
    return F.when(n >= width, means).otherwise(F.array().cast("array<double>"))


def fragment_count(length: Column, frag_len: int, step: int) -> Column:
    """Training fragments of a sequence: floor((1 + L - fragment) / step), at least 0."""
    return F.greatest(F.floor((1 + length - frag_len) / step), F.lit(0)).cast("int")


def training_fragments(df: DataFrame, frag_len: int, step: int, length: Column) -> DataFrame:
    """Adds frag, start, end: start = i * step, end = start + (fragment // step) * step."""
    n = fragment_count(length, frag_len, step)
    out = df.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))).alias("frag"))
    return out.withColumn("start", F.col("frag") * step).withColumn("end", F.col("start") + frag_len // step * step)


def latent_fragments(df: DataFrame, frag_len: int, n_frags: int, length: Column) -> DataFrame:
    """Adds frag, start, end of n_frags evenly spaced, possibly overlapping fragments of sequences of frag_len or more."""
    out = df.where(length >= frag_len).withColumn("_step", ((length - frag_len) / n_frags).cast("int"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_frags - 1))).alias("frag"))
    return out.withColumn("start", F.col("frag") * F.col("_step")).withColumn("end", F.col("start") + frag_len).drop("_step")


def optimal_distance(n: Column, fppc: int) -> Column:
    """Largest distance at which n fragments still have fppc pairs; may be 0 or less."""
    return (n + 0.5 * (1 - F.sqrt(F.lit(8.0 * fppc + 1)))).cast("int")
