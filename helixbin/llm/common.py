"""What the operators of this subpackage share: shared-storage materialisation and byte-level numpy helpers."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Bytes of text that a Python worker turns into numpy arrays at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Odd multiplier of the polynomial hashes and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

# One random 64-bit value per byte: a polynomial modulo 2**64 over raw bytes has known collisions.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a temporary one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        configured = tempfile.mkdtemp(prefix="helixbin-")
        atexit.register(shutil.rmtree, configured, True)
        sc.setCheckpointDir(f"file://{configured}")
        configured = sc.getCheckpointDir()
    return configured.rstrip("/")


#: Paths written in each open ``settled`` call, the innermost last.
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to shared storage once and read it back, so that later jobs neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixbin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more from shared storage."""
    sc = df.sparkSession.sparkContext
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written, and whose tables on the way to it are then removed from shared storage."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own: list[str] = []
        _SCOPES.append(own)
        try:
            out = operator(docs, *args, **options)
        finally:
            _SCOPES.pop()
        out = materialize(out)
        sc = docs.sparkSession.sparkContext
        for path in own:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        return out

    return run


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that nothing refers to any more; else they stay until the driver needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int = 20000) -> DataFrame:
    """A materialized table, hinted for broadcast if its counted rows are few; otherwise as it is, for a shuffled join."""
    return broadcast(df) if df.count() <= most_rows else df


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a string column as (lo, hi, bytes, offsets): text i of the chunk is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(data[j]) * BASE**j for j < i."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of data[lo:hi] that do not depend on where the string stands."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return (prefix[hi] - prefix[lo]) * inverse[lo]


def sums_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each text; empty texts give 0."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
