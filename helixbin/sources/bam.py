"""BAM files as a Spark data source: split between compressed blocks, pruned by their index, and written as a folder of indexed parts.

A file is planned by its size alone. Each task looks for the first compressed block from its offset on, then for the first byte
there at which a chain of plausible records begins, and reads all records that begin before its end; a record that goes on
in the next task's blocks is read to its end. With regions the index gives the exact ranges of blocks instead.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS by the path's scheme).
"""

from __future__ import annotations

import functools
import json
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, INDEX_MAGIC, BLOCK_MAGIC = b"BAM\1", b"BAI\1", b"\x1f\x8b\x08\x04"
CIGAR, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
REFERENCE, QUERY, ALIGNED = "MDN=X", "MIS=X", "MI=X"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
LINEAR_SHIFT = 14
RECORD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])

SCHEMA = "sample int, contig string, flag int, mapq int, ref_start int, ref_end int, tlen int, qlen int, qalen int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Compressed bytes of a task and of a read, decompressed bytes of a batch, uncompressed bytes of a written block.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20, 4 << 20, 65280
#: Records that must follow each other for a place to count as the start of one.
CHAIN = 4


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def expanded(path: str) -> list[str]:
    """The file, or the BAM files of a folder in order of their names."""
    system, own = _opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(own)) if f.base_name.endswith(".bam"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def is_bam(path: str) -> bool:
    """A BAM file by its name, or a folder that holds such files."""
    if path.endswith(".bam"):
        return True
    system, own = _opened(path)
    return system.get_file_info(own).type == fs.FileType.Directory and bool(expanded(path))


class Blocks:
    """Random access to the compressed blocks of a file."""

    def __init__(self, path: str) -> None:
        system, own = _opened(path)
        info = system.get_file_info(own)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(path)
        self.path, self.size, self.read = path, info.size, 0
        self._file, self._at, self._window = system.open_input_file(own), 0, b""

    def _bytes(self, offset: int, n: int) -> bytes:
        if not (self._at <= offset and offset + n <= self._at + len(self._window)):
            self._at, self._window = offset, self._file.read_at(min(max(READ_BYTES, n), self.size - offset), offset)
        return self._window[offset - self._at : offset - self._at + n]

    def _length(self, offset: int) -> int:
        """Length of the block that begins here, 0 if none does."""
        head = self._bytes(offset, min(1 << 9, self.size - offset))
        if len(head) < 18 or head[:4] != BLOCK_MAGIC:
            return 0
        at, end = 12, 12 + int.from_bytes(head[10:12], "little")
        while at + 6 <= min(end, len(head)):
            n = int.from_bytes(head[at + 2 : at + 4], "little")
            if head[at : at + 2] == b"BC" and n == 2:
                return int.from_bytes(head[at + 4 : at + 6], "little") + 1
            at += 4 + n
        return 0

    def find(self, offset: int) -> int:
        """The first block from here on; the size of the file if there is none. A block is followed by another or the end."""
        while offset < self.size:
            window = self._bytes(offset, min(1 << 17, self.size - offset))
            at = window.find(BLOCK_MAGIC)
            if at < 0:
                offset += max(1, len(window) - 3)
                continue
            offset += at
            n = self._length(offset)
            if n and (offset + n == self.size or offset + n < self.size and self._length(offset + n)):
                return offset
            offset += 1
        return self.size

    def data(self, offset: int) -> tuple[bytes, int]:
        """(decompressed data, offset of the next block)."""
        n = self._length(offset)
        raw = self._bytes(offset, n) if n else b""
        if not n or len(raw) < n:
            raise ValueError(f"{self.path}: no block at byte {offset}")
        start = 12 + int.from_bytes(raw[10:12], "little")
        data = zlib.decompress(raw[start : n - 8], -15)
        if zlib.crc32(data) != int.from_bytes(raw[n - 8 : n - 4], "little") or len(data) != int.from_bytes(raw[n - 4 : n], "little"):
            raise ValueError(f"{self.path}: the block at byte {offset} is damaged")
        self.read += 1
        return data, offset + n


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    lengths: tuple[int, ...]
    first: int  # virtual offset of the first record: block << 16 | place in its data


def read_header(blocks: Blocks) -> Header:
    data, marks, offset = b"", [], 0  # marks: (place of a block's data, its offset)

    def need(n: int) -> None:
        nonlocal data, offset
        while len(data) < n:
            if offset >= blocks.size:
                raise ValueError(f"{blocks.path}: the header ends early")
            marks.append((len(data), offset))
            more, offset = blocks.data(offset)
            data += more

    need(8)
    if data[:4] != MAGIC:
        raise ValueError(f"{blocks.path} is no BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    names, lengths = [], []
    for _ in range(n):
        need(at + 4)
        k = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + k)
        names.append(data[at + 4 : at + 3 + k].decode())
        lengths.append(struct.unpack_from("<i", data, at + 4 + k)[0])
        at += 8 + k
    place, block = next((m for m in reversed(marks) if m[0] <= at), (0, 0))
    return Header(tuple(names), tuple(lengths), (block << 16 | at - place) if at < len(data) else offset << 16)


@functools.lru_cache(8)
def _header(path: str, size: int) -> Header:
    return read_header(Blocks(path))


def _plausible(data: bytes, at: int, header: Header) -> int:
    """Length of the record that may begin here; 0 if none can, -1 if too little of it is there to tell."""
    if at + RECORD.itemsize > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < len(header.names) and -1 <= next_ref < len(header.names) and pos >= -1 and next_pos >= -1 and l_name >= 1 and l_seq >= 0):
        return 0
    if ref >= 0 and pos > header.lengths[ref] or next_ref >= 0 and next_pos > header.lengths[next_ref]:
        return 0
    if size < RECORD.itemsize - 4 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return 0
    name = data[at + RECORD.itemsize : at + RECORD.itemsize + l_name]
    if len(name) < l_name:
        return -1
    if name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1]):
        return 0
    operations = data[at + RECORD.itemsize + l_name : at + RECORD.itemsize + l_name + 4 * n_cigar : 4]
    return 4 + size if all(c & 15 < len(CIGAR) for c in operations) else 0


def _first_record(blocks: Blocks, offset: int, end: int, header: Header) -> int | None:
    """Virtual offset of the first record that begins in a block from offset on and before end; None if none does."""
    data, marks, after = b"", [], offset

    def more() -> bool:
        nonlocal data, after
        if after >= blocks.size:
            return False
        marks.append((len(data), after))
        found, after = blocks.data(after)
        data += found
        return True

    def starts(at: int) -> bool:
        for _ in range(CHAIN):
            while (n := _plausible(data, at, header)) < 0 and more():
                pass
            if n < 0:
                return at == len(data)  # the file ends where a record does
            if n == 0:
                return False
            at += n
            while at > len(data) and more():
                pass
        return True

    at = 0
    while True:
        while at >= len(data):
            if after >= end or not more():
                return None
        place, block = next(m for m in reversed(marks) if m[0] <= at)
        if block >= end:
            return None
        if starts(at):
            return block << 16 | at - place
        at += 1


def record_batches(blocks: Blocks, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, starts) of the complete records from the virtual offset begin on that begin before the virtual offset end."""
    offset, at = begin >> 16, begin & 0xFFFF
    end_block, end_place = end >> 16, end & 0xFFFF
    unpack = struct.Struct("<i").unpack_from
    data, limit = bytearray(), 0  # records that begin before limit are this task's

    def add() -> None:
        nonlocal offset, limit
        own = 1 << 16 if offset < end_block else end_place if offset == end_block else 0
        found, offset = blocks.data(offset)
        if own:
            limit = len(data) + min(own, len(found))
        data.extend(found)

    def end_of(at: int) -> int:
        return at + 4 + struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else at + 4

    while True:
        while len(data) - at < BATCH_BYTES and offset < blocks.size and offset << 16 < end:
            add()
        starts, size = [], len(data)
        while at < limit:
            if at + 4 <= size and (after := at + 4 + unpack(data, at)[0]) <= size:
                starts.append(at)
                at = after
                continue
            while not starts and end_of(at) > len(data) and offset < blocks.size:  # of the next task, or a very long record
                add()
            if end_of(at) > len(data):
                break
            starts.append(at)
            at, size = end_of(at), len(data)
        if starts:
            yield np.frombuffer(bytes(data), np.uint8), np.array(starts, np.int64)
        elif at < limit:
            raise ValueError(f"{blocks.path}: the last record is not complete")
        elif offset >= blocks.size or offset << 16 >= end:
            return
        del data[:at]
        limit, at = limit - at, 0


def _flattened(first: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """Places first, first + step, ... of each run of count."""
    before = np.cumsum(count) - count
    return np.repeat(first - step * before, count) + step * np.arange(count.sum())


def _long_cigar(data: np.ndarray, begin: int, end: int) -> np.ndarray | None:
    """The operations that a record keeps in its CG tag, as they were too many for the record's field."""
    widths = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    raw, at = data[begin:end].tobytes(), 0
    while at + 3 < len(raw):
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            if tag == b"CG":
                return np.frombuffer(raw, "<u4", n, at + 5)
            at += 5 + n * widths[chr(raw[at])]
        else:
            at += widths[kind]
    return None


def decoded(data: np.ndarray, starts: np.ndarray, names: pa.Array, sample: int) -> pa.RecordBatch:
    """The columns of SCHEMA of records at these places. Reads without a contig have ``*``."""
    head = data[starts[:, None] + np.arange(RECORD.itemsize)].view(RECORD)[:, 0]
    count = head["n_cigar"].astype(np.int64)
    first = starts + RECORD.itemsize + head["l_name"]
    places = _flattened(first, count, 4)
    operations = data[places[:, None] + np.arange(4)].view("<u4")[:, 0] if len(places) else np.zeros(0, "<u4")
    owner = np.repeat(np.arange(len(starts)), count)
    before = np.cumsum(count) - count
    two = np.flatnonzero((count == 2) & (head["l_seq"] > 0))
    for r in two[(operations[before[two]] == (head["l_seq"][two].astype(np.int64) << 4 | CIGAR.index("S"))) & (operations[before[two] + 1] & 15 == CIGAR.index("N"))]:
        rest = int(first[r] + 8 + (head["l_seq"][r] + 1) // 2 + head["l_seq"][r])
        found = _long_cigar(data, rest, int(starts[r] + 4 + head["size"][r]))
        if found is not None:
            operations, owner = np.concatenate([operations[owner != r], found]), np.concatenate([owner[owner != r], np.full(len(found), r)])
    sums = {}
    for letters in (REFERENCE, QUERY, ALIGNED):
        counts = np.array([c in letters for c in CIGAR + "?" * 7])
        sums[letters] = np.bincount(owner, (operations >> 4) * counts[operations & 15], len(starts)).astype(np.int32)
    pos, ref = head["pos"].astype(np.int32), head["ref"]
    contig = names.take(pa.array(np.where(ref >= 0, ref, len(names) - 1)))
    qlen = np.where(head["l_seq"] > 0, head["l_seq"], sums[QUERY]).astype(np.int32)
    arrays = [np.full(len(starts), sample, np.int32), contig, head["flag"].astype(np.int32), head["mapq"].astype(np.int32), pos, pos + sums[REFERENCE], head["tlen"].astype(np.int32), qlen, sums[ALIGNED]]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], NAMES)


# The index.


def index_path(path: str) -> str | None:
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        system, own = _opened(name)
        if system.get_file_info(own).type == fs.FileType.File:
            return name
    return None


@dataclass(frozen=True)
class Index:
    """Of each contig: chunks (begin, end) of virtual offsets by bin, and the least offset of each window of 2**14 bases."""

    bins: tuple[dict[int, list[tuple[int, int]]], ...]
    linear: tuple[np.ndarray, ...]

    def ranges(self, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records of a contig that overlap begin to end; adjacent ones are joined."""
        linear = self.linear[ref]
        window = begin >> LINEAR_SHIFT
        least = int(linear[min(window, len(linear) - 1)]) if len(linear) else 0
        found = []
        for first, shift in BIN_LEVELS:
            for b in range(first + (begin >> shift), first + (max(begin, end - 1) >> shift) + 1):
                found += [c for c in self.bins[ref].get(b, ()) if c[1] > least]
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            lo = max(lo, least)
            if out and lo >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def cuts(self, ref: int, begin: int, end: int, split: int) -> list[int]:
        """Starts of records between two virtual offsets, about split bytes of the file apart."""
        out = [begin]
        for v in self.linear[ref]:
            if out[-1] + (split << 16) <= v < end:
                out.append(int(v))
        return [*out, end]


def read_index(path: str) -> Index:
    system, own = _opened(path)
    with system.open_input_file(own) as f:
        raw = f.read()
    try:
        if raw[:4] != INDEX_MAGIC:
            raise ValueError
        n, at, bins, linear = struct.unpack_from("<i", raw, 4)[0], 8, [], []
        for _ in range(n):
            own_bins = {}
            n_bin, at = struct.unpack_from("<i", raw, at)[0], at + 4
            for _ in range(n_bin):
                b, k = struct.unpack_from("<Ii", raw, at)
                offsets = np.frombuffer(raw, "<u8", 2 * k, at + 8).reshape(-1, 2)
                own_bins[b] = [(int(x), int(y)) for x, y in offsets]
                at += 8 + 16 * k
            k, at = struct.unpack_from("<i", raw, at)[0], at + 4
            windows = np.frombuffer(raw, "<u8", k, at)
            at += 8 * k
            bins.append({b: c for b, c in own_bins.items() if b < 37450})  # higher ones hold counts
            linear.append(np.maximum.accumulate(windows) if k else windows)  # windows without records have 0
    except (ValueError, struct.error) as error:
        raise ValueError(f"{path} is no index of a BAM file") from error
    return Index(tuple(bins), tuple(linear))


def index_fault(path: str) -> str | None:
    """What is wrong with the index of a file: missing, older than it, of other contigs, or pointing beyond it."""
    found = index_path(path)
    if found is None:
        return f"{path}: no index"
    (system, own), (other, its) = _opened(path), _opened(found)
    file, index_info = system.get_file_info(own), other.get_file_info(its)
    if index_info.mtime_ns is not None and file.mtime_ns is not None and index_info.mtime_ns < file.mtime_ns:
        return f"{path}: its index is older than the file"
    try:
        index = read_index(found)
    except ValueError as error:
        return str(error)
    if len(index.bins) != len(_header(path, file.size).names):
        return f"{path}: its index has {len(index.bins)} contigs, the file {len(_header(path, file.size).names)}"
    if max((c[1] >> 16 for b in index.bins for cs in b.values() for c in cs), default=0) > file.size:
        return f"{path}: its index points beyond the file"
    return None


def check_indexes(paths: list[str]) -> None:
    """Raises for all files whose index is missing or stale, not for the first only."""
    faults = [f for p in paths for q in expanded(p) if (f := index_fault(q))]
    if faults:
        raise ValueError("; ".join(faults))


# The data source.


@dataclass
class Piece(InputPartition):
    path: str
    sample: int
    begin: int  # virtual offsets, or -1: the first record from byte ``at`` on
    end: int
    at: int = 0
    regions: tuple[tuple[int, int, int], ...] = ()
    more: tuple[tuple[int, int], ...] = ()  # further ranges of the file


class BamReader(DataSourceReader):
    """Options: paths (a JSON list; each file or folder is a sample), split_bytes, contigs (a JSON list), window ([begin, end])."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.contigs = json.loads(options["contigs"]) if "contigs" in options else None
        self.window = tuple(json.loads(options["window"])) if "window" in options else None
        self.blocks_read = 0

    def partitions(self) -> list[Piece]:
        out = []
        for sample, path in enumerate(self.paths):
            for file in expanded(path):
                out += self._by_index(file, sample) if self.contigs is not None or self.window else self._by_size(file, sample)
        return out or [Piece("", 0, 0, 0)]

    def _by_size(self, file: str, sample: int) -> list[Piece]:
        system, own = _opened(file)
        size = system.get_file_info(own).size
        cuts = [*range(0, size, self.split), size]
        return [Piece(file, sample, -1, hi << 16, lo) for lo, hi in zip(cuts, cuts[1:])]

    def _by_index(self, file: str, sample: int) -> list[Piece]:
        if fault := index_fault(file):
            raise ValueError(fault)
        header, index = _header(file, Blocks(file).size), read_index(index_path(file))
        wanted = None if self.contigs is None else set(self.contigs)
        out = []
        for ref, name in enumerate(header.names):
            if wanted is not None and name not in wanted:
                continue
            begin, end = self.window or (0, 1 << 29)
            ranges = [r for lo, hi in index.ranges(ref, begin, end) for cuts in [index.cuts(ref, lo, hi, self.split)] for r in zip(cuts, cuts[1:])]
            for lo, hi in ranges:
                # neighbouring ranges share a task up to its size
                if out and out[-1].end >> 16 >= lo >> 16 and (hi - out[-1].begin) >> 16 < self.split:
                    out[-1].end, out[-1].regions = max(out[-1].end, hi), (*out[-1].regions, (ref, begin, end))
                else:
                    out.append(Piece(file, sample, lo, hi, regions=((ref, begin, end),)))
        # ranges that are not neighbours share a task too, or a window would be a task a contig
        shared: list[Piece] = []
        total = 0
        for piece in out:
            size = (piece.end >> 16) - (piece.begin >> 16) + BLOCK_BYTES
            if shared and total + size < self.split:
                shared[-1].more += ((piece.begin, piece.end),)
                shared[-1].regions += piece.regions
                total += size
            else:
                shared.append(piece)
                total = size
        return shared

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        blocks = Blocks(piece.path)
        header = _header(piece.path, blocks.size)
        names = pa.array([*header.names, "*"])
        begin: int | None = piece.begin
        if begin < 0:
            first = blocks.find(piece.at) if piece.at else 0
            begin = header.first if first <= header.first >> 16 else _first_record(blocks, first, piece.end >> 16, header)
        for lo, hi in ((begin, piece.end), *piece.more):
            if lo is None or lo >= hi:
                continue
            for data, starts in record_batches(blocks, lo, hi):
                batch = decoded(data, starts, names, piece.sample)
                if piece.regions:
                    batch = batch.filter(pa.array(self._inside(data, starts, batch, piece.regions)))
                if batch.num_rows:
                    yield batch
        self.blocks_read += blocks.read

    @staticmethod
    def _inside(data: np.ndarray, starts: np.ndarray, batch: pa.RecordBatch, regions: tuple[tuple[int, int, int], ...]) -> np.ndarray:
        ref = data[starts[:, None] + np.arange(4, 8)].view("<i4")[:, 0]
        lo, hi = batch.column("ref_start").to_numpy(), batch.column("ref_end").to_numpy()
        begin, end = regions[0][1:]  # the same for all contigs
        return np.isin(ref, sorted({r[0] for r in regions})) & (lo < end) & (np.maximum(hi, lo + 1) > begin)


@dataclass
class Part(WriterCommitMessage):
    path: str


class BamWriter(DataSourceWriter):
    """Writes rows (name, flag, contig, pos, mapq, cigar, tlen, seq), sorted by contig and position in each partition, as a folder of
    BAM files with an index each. A contig's length is the end of its last read in the file. A failed task's file is removed."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, rows: Iterator) -> Part:
        system, own = _opened(self.path)
        system.create_dir(own, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        body, index, names, ends = _body(rows)
        with body:
            text = b"@HD\tVN:1.6\tSO:coordinate\n" + b"".join(b"@SQ\tSN:%s\tLN:%d\n" % (n.encode(), e) for n, e in zip(names, ends))
            head = MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
            head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", e) for n, e in zip(names, ends))
            packed = b"".join(_block(head[i : i + BLOCK_BYTES]) for i in range(0, len(head), BLOCK_BYTES))
            with system.open_output_stream(f"{own}/{name}") as f:
                f.write(packed)
                body.seek(0)
                while chunk := body.read(READ_BYTES):
                    f.write(chunk)
                f.write(END_BLOCK)
        with system.open_output_stream(f"{own}/{name}.bai") as f:
            f.write(_packed_index(index, len(packed)))
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        self._only({m.path for m in messages if m} if self.overwrite else None)

    def abort(self, messages: list[Part | None]) -> None:
        system, own = _opened(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{own}/{m.path}")
                system.delete_file(f"{own}/{m.path}.bai")

    def _only(self, kept: set[str] | None) -> None:
        system, own = _opened(self.path)
        for f in system.get_file_info(fs.FileSelector(own, allow_not_found=True)):
            if kept is not None and f.base_name.removesuffix(".bai") not in kept:
                system.delete_file(f.path)


class BamArrowWriter(BamWriter, DataSourceArrowWriter):
    """As BamWriter, from Arrow batches, so that Spark makes no row objects."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        return super().write(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return END_BLOCK[:16] + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(begin: int, end: int) -> int:
    """The smallest bin of the index that holds begin to end."""
    for first, shift in reversed(BIN_LEVELS):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


@functools.lru_cache(1 << 14)
def _operations(cigar: str) -> tuple[int, bytes, int]:
    """(number of operations, their bytes, bases of the reference that they span, at least 1)."""
    found = [(int(n), CIGAR.index(c)) for n, c in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return len(found), b"".join(struct.pack("<I", n << 4 | c) for n, c in found), max(1, sum(n for n, c in found if CIGAR[c] in REFERENCE))


def _body(rows: Iterator):
    """(compressed records without a header, index by contig, contigs, their ends); the records wait on the worker's disk, as the header
    that precedes them needs all contigs."""
    letters, fixed, count = {c: i for i, c in enumerate(LETTERS)}, struct.Struct("<iiiBBHHHiiii").pack, RECORD.itemsize - 4
    out = tempfile.SpooledTemporaryFile(1 << 24)
    pending, written = bytearray(), 0
    names: dict[str, int] = {}
    ends: list[int] = []
    index: list[tuple[dict[int, list[list[int]]], dict[int, int]]] = []
    last = (-1, -1)
    for name, flag, contig, pos, mapq, cigar, tlen, seq in rows:
        ref = names.setdefault(contig, len(names))
        if ref == len(ends):
            ends.append(0)
            index.append(({}, {}))
        if (ref, pos) < last:
            raise ValueError("rows must be sorted by contig and position")
        last = (ref, pos)
        n_operations, operations, span = _operations(cigar)
        ends[ref] = max(ends[ref], pos + span)
        title = name.encode() + b"\0"
        b = bin_of(pos, pos + span)
        if seq is None or seq == "*":
            length, bases = 0, b""
        else:
            length, nibbles = len(seq), [letters.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
            bases = bytes(x << 4 | y for x, y in zip(nibbles[::2], nibbles[1::2])) + b"\xff" * length
        rest = title + operations + bases
        record = fixed(count + len(rest), ref, pos, len(title), mapq, b, n_operations, flag, length, -1, -1, tlen) + rest
        begin = written << 16 | len(pending)
        pending += record
        while len(pending) >= BLOCK_BYTES:
            written += out.write(_block(bytes(pending[:BLOCK_BYTES])))
            del pending[:BLOCK_BYTES]
        end = written << 16 | len(pending)
        chunks = index[ref][0].setdefault(b, [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for w in range(pos >> LINEAR_SHIFT, (pos + span - 1 >> LINEAR_SHIFT) + 1):
            index[ref][1].setdefault(w, begin)
    if pending:
        out.write(_block(bytes(pending)))
    return out, index, list(names), ends


def _packed_index(index: list, shift: int) -> bytes:
    moved = lambda v: v + (shift << 16)
    out = INDEX_MAGIC + struct.pack("<i", len(index))
    for bins, linear in index:
        out += struct.pack("<i", len(bins))
        for b, chunks in sorted(bins.items()):
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", moved(x), moved(y)) for x, y in chunks)
        n = max(linear, default=-1) + 1
        out += struct.pack("<i", n) + b"".join(struct.pack("<Q", moved(linear[w]) if w in linear else 0) for w in range(n))
    return out


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BamArrowWriter:
        return BamArrowWriter(dict(self.options), overwrite)


def read_bam(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES, contigs: list[str] | None = None, window: tuple[int, int] | None = None) -> DataFrame:
    """The columns of ``read_sam`` of BAM files (or folders of them), numbered as samples in order. With contigs or a window of positions
    the index decides what is read: reads of these contigs that overlap the window."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("paths", json.dumps(paths)).option("split_bytes", str(split_bytes))
    if contigs is not None:
        reader = reader.option("contigs", json.dumps(contigs))
    if window is not None:
        reader = reader.option("window", json.dumps(list(window)))
    return reader.load()


def write_bam(rows: DataFrame, path: str) -> None:
    """Rows (name, flag, contig, pos, mapq, cigar, tlen, seq) as a folder of sorted BAM files with indexes; a contig is in one file."""
    spark = rows.sparkSession
    spark.dataSource.register(BamSource)
    names = ["name", "flag", "contig", "pos", "mapq", "cigar", "tlen", "seq"]
    # a fixed number of files: records are small for Spark and take long to write, so few large partitions would leave workers idle
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.select(*names).repartition(files, "contig").sortWithinPartitions("contig", "pos").write.format("bam").mode("overwrite").save(path)
