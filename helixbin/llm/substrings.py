"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus are removed.

Positions are compared by prefix polynomial hashes: a hash of any substring takes two array reads, so common extensions are
found by binary search (``common_extension``) and suffixes are sorted by mergesort with logarithmic comparisons, bytes deciding
where hashes agree (``suffix_order``). A sort of all suffixes of a corpus would shuffle a row a byte. So windows are first dealt
to anchors: the anchor of a 100-byte window is its GRAM-byte substring of least hash. Equal windows have equal anchors at equal
offsets, an anchor serves consecutive windows, and there is about one anchor in 35 bytes.

1. Each anchor sends its hash and that of its context, the bytes of all windows it serves. If the context occurs earlier, all
   its windows are repeats. Contexts that occur once in a chunk of texts are sent on; the chunk's other copies are settled there.
2. Anchors whose hash has several contexts may share some windows only. The first occurrence of each such context sends the
   hashes of its windows; in a chunk, suffixes are sorted to find equal ones, and equal strings are sent once.
3. Texts meet their repeats, and what is covered is cut out.

96 bits of hash must agree for windows of different chunks to count as equal, 128 for contexts; inside a chunk the bytes are compared.

Defined results: null text is empty; texts under 100 bytes stay; rows of equal doc_id and text are one document and get equal
results; a null id is later than all others; texts of 2**27 bytes or more raise ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbin.llm.common import byte_chunks, materialize, mix64, prefix_hashes, range_hashes
from helixbin.llm.mixing import ranked

LENGTH, GRAM = 100, 32
#: Bytes of text whose anchors are found side by side.
SIDE_BY_SIDE = 1 << 20
#: A byte's place in the corpus is its document's number times 2**START_BITS plus its place in the text.
ID_BITS, START_BITS = 36, 27
LOCAL = 1 << 20  # marks anchors that their chunk has settled


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the longest common prefix, up to limit, of the suffixes at x and y: binary search on substring hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    last = len(prefix) - 1
    hi = np.minimum(hi, np.minimum(last - x, last - y))
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = range_hashes(prefix, x, x + mid) == range_hashes(prefix, y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_order(data: np.ndarray, starts: np.ndarray, limit: int = LENGTH, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first limit bytes, ties by start, and the common extension of each with its
    predecessor. Bottom-up mergesort: all pairs of runs of a round merge at once, each element finding its place by binary search."""
    prefix = prefix_hashes(data) if prefix is None else prefix
    padded = np.r_[data.astype(np.int16), np.full(1, -1, np.int16)]

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = common_extension(prefix, x, y, limit)
        at_x, at_y = padded[np.minimum(x + n, len(data))], padded[np.minimum(y + n, len(data))]
        return np.where(n == limit, x < y, np.where(at_x == at_y, x < y, at_x < at_y))

    order = np.sort(starts.astype(np.int64))
    n, width = len(order), 1
    place = np.arange(n)
    while width < n:
        run = place // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        lo, hi = np.minimum(other, n), np.minimum(other + width, n)
        begin = lo.copy()
        while (lo < hi).any():
            live = np.flatnonzero(lo < hi)
            mid = (lo[live] + hi[live]) // 2
            below = less(order[mid], order[live])
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        new = (run // 2) * 2 * width + (place - run * width) + (lo - begin)
        merged = np.empty_like(order)
        merged[new] = order
        order, width = merged, width * 2
    shared = np.r_[0, common_extension(prefix, order[1:], order[:-1], limit)] if n else np.zeros(0, np.int64)
    for i in np.flatnonzero(shared == limit).tolist():  # collision verification
        if data[order[i] : order[i] + limit].tobytes() != data[order[i - 1] : order[i - 1] + limit].tobytes():
            raise ArithmeticError("two different strings have equal hashes")
    return order, shared


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, anchor, last window) of all anchors of the texts, as places in data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    grams = np.arange(len(data) - GRAM + 1)
    key = (mix64(range_hashes(prefix, grams, grams + GRAM)) & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    least = (_sliding_min(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(least) + 1, np.int64)
    sizes = np.diff(offsets)
    long = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(window):
        return none, none, none, none
    a = least[window]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    return np.searchsorted(offsets, window[first], "right") - 1, window[first], a[first], window[last]


def _anchored(docs: DataFrame) -> DataFrame:
    """(h, ctx, g, ol) of every anchor of docs (text, rid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = np.asarray(batch.column(1))
            for lo, _, data, offsets in byte_chunks(batch.column(0), SIDE_BY_SIDE):
                if np.diff(offsets).max(initial=0) >> START_BITS:
                    raise ValueError(f"a text has 2**{START_BITS} bytes or more")
                prefix = prefix_hashes(data)
                text, first, anchor, last = anchors(data, offsets, prefix)
                h = mix64(range_hashes(prefix, anchor, anchor + GRAM) + np.uint64(1))
                ol = ((anchor - first) << 8) | (last - first)
                ctx = mix64(range_hashes(prefix, first, last + LENGTH) + mix64(ol.astype(np.uint64)))
                g = (rid[lo + text] << START_BITS) | (first - offsets[text])
                order = np.lexsort((g, ctx, h))
                repeated = np.zeros(len(g), bool)
                repeated[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (ctx[order[1:]] == ctx[order[:-1]])
                h = np.where(repeated, mix64(g.astype(np.uint64)), h)
                ol = np.where(repeated, ol | LOCAL, ol)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(g), pa.array(ol.astype(np.int32))], names=["h", "ctx", "g", "ol"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text"), "rid").mapInArrow(run, "h bigint, ctx bigint, g bigint, ol int")


def _zipped(docs: DataFrame) -> DataFrame:
    """(rid, z): compressed texts, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [pack.compress((t.as_py() or "").encode()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(z, pa.binary())], names=["rid", "z"])

    return docs.select("text", "rid").mapInArrow(run, "rid bigint, z binary")


def _window_hashes(texts: DataFrame, open_anchors: DataFrame) -> DataFrame:
    """(h, w, g): hash of the anchor and of the window, and place, of the windows that the anchors serve; the place of a window that
    the chunk has found to be a repeat is ~g."""
    by_text = open_anchors.groupBy(F.shiftright("g", START_BITS).alias("rid")).agg(F.sort_array(F.collect_list(F.struct(F.col("g").bitwiseAND((1 << START_BITS) - 1).alias("lo"), "ol", "h"))).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for r0 in range(0, batch.num_rows, 256):
                part = batch.slice(r0, 256)
                raw = [np.frombuffer(unpack.decompress(z.as_py()), np.uint8) for z in part.column(1)]
                lists = part.column(2)
                flat = lists.flatten()
                counts = np.asarray(lists.value_lengths()).astype(np.int64)
                base = np.cumsum([0, *map(len, raw)])
                data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
                prefix = prefix_hashes(data)
                own = np.repeat(np.arange(len(raw)), counts)
                lo, size, h = np.asarray(flat.field(0)), (np.asarray(flat.field(1)) & 255).astype(np.int64) + 1, np.asarray(flat.field(2))
                each = np.repeat(np.arange(len(lo)), size)
                start = (base[own] + lo)[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                g = (np.asarray(part.column(0))[own[each]] << START_BITS) | (start - base[own[each]])
                w = mix64(range_hashes(prefix, start, start + LENGTH) + np.uint64(7))
                hh = h[each]
                # equal windows of the chunk: candidates by hash, decided by suffix order, the earliest sent on
                order = np.lexsort((g, w))
                twin = np.zeros(len(w), bool)
                twin[order[1:]] = w[order[1:]] == w[order[:-1]]
                local = np.zeros(len(w), bool)
                if twin.any():
                    groups = np.cumsum(~twin[order])
                    many = np.isin(groups, groups[twin[order]])
                    some = order[many]
                    sequence, shared = suffix_order(data, start[some], LENGTH, prefix)
                    number = np.cumsum(shared < LENGTH)
                    cls = np.empty(len(some), np.int64)
                    cls[np.argsort(start[some], kind="stable")] = number[np.argsort(sequence, kind="stable")]
                    by = np.lexsort((g[some], cls))
                    local[some[by[1:]]] = cls[by[1:]] == cls[by[:-1]]
                # 96 bits tell windows of different chunks apart: the anchor's hash sends 32 of its own
                yield pa.RecordBatch.from_arrays([pa.array(np.where(local, g, hh).astype(np.int64).view(np.uint64).astype(np.uint32).view(np.int32)), pa.array(w.view(np.int64)), pa.array(np.where(local, ~g, g))], names=["h", "w", "g"])

    return texts.join(by_text, "rid").select("rid", "z", "a").mapInArrow(run, "h int, w bigint, g bigint")


def numbered(docs: DataFrame) -> DataFrame:
    """Distinct documents (rid, did, tk, text) of docs (doc_id, text); rid is in the order of ids, null last, and below 2**ID_BITS."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    ids = rows.select("did", "tk")
    lo, hi, n = ids.agg(F.min("did"), F.max("did"), F.count(F.lit(1))).first()
    if n == 0 or (lo >= 0 and hi < 1 << ID_BITS and not ids.groupBy("did").count().where("count > 1").limit(1).count()):
        return rows.withColumn("rid", F.col("did"))
    names = ranked(ids.distinct().select("did", "tk", F.struct("did", "tk").alias("k")), "k", "rid").select("did", "tk", "rid")
    return materialize(rows.dropDuplicates(["did", "tk"]).join(names, ["did", "tk"]))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated stretches (rid, lo, size) of numbered docs, overlapping ones included, and the docs' compressed texts."""
    found = _anchored(docs).repartition("h")
    by_context, by_anchor = Window.partitionBy("h", "ctx"), Window.partitionBy("h")
    found = found.withColumn("f", F.min("g").over(by_context)).withColumn("c0", F.min("ctx").over(by_anchor)).withColumn("c1", F.max("ctx").over(by_anchor))
    whole = (F.col("ol") >= LOCAL) | (F.col("g") > F.col("f"))
    found = materialize(found.select("g", "ol", "h", whole.alias("whole"), (F.col("c0") != F.col("c1")).alias("open")).where("whole OR open"))
    texts = _zipped(docs)
    windows = _window_hashes(texts, found.where("NOT whole")).repartition("h", "w")
    earliest = F.min(F.when(F.col("g") >= 0, F.col("g"))).over(Window.partitionBy("h", "w"))
    later = windows.withColumn("f", earliest).where("g < 0 OR g > f").withColumn("g", F.when(F.col("g") < 0, F.bitwise_not("g")).otherwise(F.col("g")))
    one = lambda df, size: df.select(F.shiftright("g", START_BITS).alias("rid"), F.col("g").bitwiseAND((1 << START_BITS) - 1).alias("lo"), size.cast("int").alias("size"))
    return one(found.where("whole"), F.col("ol").bitwiseAND(255) + LENGTH).union(one(later, F.lit(LENGTH))), texts


def cut(text: bytes, lo: np.ndarray, size: np.ndarray) -> tuple[bytes, int, int]:
    """The remaining bytes, and the numbers of removed bytes and of maximal removed runs."""
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, lo, 1)
    np.add.at(depth, lo + size, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def deduplicated(named: DataFrame, texts: bool = False) -> DataFrame:
    """One row per numbered document: rid, n_bytes, n_removed, n_spans, kept_sha256, and with texts also the kept bytes."""
    spans, zipped = repeats(named)
    by_text = spans.groupBy("rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("size").alias("size"))
    fields = "rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for rid, z, lo, size in zip(*batch.columns):
                raw = unpack.decompress(z.as_py())
                kept, removed, runs = cut(raw, np.asarray(lo.values, np.int64), np.asarray(size.values, np.int64)) if lo.is_valid else (raw, 0, 0)
                rows.append((rid.as_py(), len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] * texts)))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split(" ")[0] for x in fields.split(", ")])

    return zipped.join(by_text, "rid", "left").mapInArrow(run, fields)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs (doc_id, text) with n_bytes, n_removed, n_spans and kept_sha256, for every row."""
    named = numbered(docs)
    got = materialize(deduplicated(named))
    did, tk = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), did.alias("did"), tk.alias("tk"))
    out = rows.join(named.select("rid", "did", "tk"), ["did", "tk"]).join(got, "rid")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
