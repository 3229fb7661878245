"""BAM files against their SAM twins, splits inside records, region scans by the index, and faults of indexes and files."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from helixbin.sources import bam, files

ROWS = "name string, flag int, contig string, pos int, mapq int, cigar string, tlen int, seq string"


def reads(n, seed=0, long_every=0, span=200_000):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        ops = [(rng.randrange(1, 30), c) for c in rng.choice(["M", "SM", "MIM", "MDM", "SMNM=XS", "HMPM"])]
        if long_every and k % long_every == 0:
            ops = [(150_000, "M")]
        length = sum(x for x, c in ops if c in bam.QUERY)
        seq = "*" if k % 7 == 0 else "".join(rng.choices("ACGTN", k=length))
        out.append((f"read{k}", rng.choice([0, 16, 256, 1024, 4]), f"V{rng.randrange(5)}", rng.randrange(span), rng.randrange(61), "".join(f"{x}{c}" for x, c in ops), rng.randrange(-500, 500), seq))
    return out


def sam_twin(path, rows):
    with open(path, "w") as f:
        f.write("@HD\tVN:1.6\n")
        for name, flag, contig, pos, mapq, cigar, tlen, seq in rows:
            f.write(f"{name}\t{flag}\t{contig}\t{pos + 1}\t{mapq}\t{cigar}\t*\t0\t{tlen}\t{seq}\t*\n")
    return str(path)


def written(spark, rows, path, parts=1):
    rows = spark.createDataFrame(rows, ROWS)
    spark.dataSource.register(bam.BamSource)
    (rows.coalesce(1) if parts == 1 else rows.repartition(parts, "contig")).sortWithinPartitions("contig", "pos").write.format("bam").mode("overwrite").save(str(path))
    return bam.expanded(str(path))


def taken(df):
    return sorted(map(tuple, df.select(*bam.NAMES).collect()))


def test_equals_its_sam_twin(spark, tmp_path):
    rows = reads(4000)
    sam = files.read_sam(spark, sam_twin(tmp_path / "a.sam", rows))
    written(spark, rows, tmp_path / "a", parts=3)
    assert taken(bam.read_bam(spark, [str(tmp_path / "a")])) == taken(sam)
    both = files.read_samples(spark, [str(tmp_path / "a"), str(tmp_path / "a.sam")])
    assert taken(both.where("sample = 0")) == taken(sam) and both.where("sample = 1").count() == len(rows)
    assert files.read_samples(spark, [str(tmp_path / "a")]).schema["contig"].dataType.simpleString() == "string"


@pytest.mark.parametrize("split", [1, 97, 1000, 20_011, 1 << 20])
def test_splits_inside_records(spark, tmp_path, monkeypatch, split):
    """Blocks of 300 bytes put nearly every record over a border; every record is read once, by the task where it begins."""
    monkeypatch.setattr(bam, "BLOCK_BYTES", 300)
    monkeypatch.setattr(bam, "BATCH_BYTES", 5000)
    rows = reads(400 if split < 100 else 3000, seed=1, long_every=211)
    path = tmp_path / "b.bam"
    _write_here(rows, path)
    monkeypatch.setattr(bam, "BLOCK_BYTES", 65280)
    reader = bam.BamReader({"path": str(path), "split_bytes": str(split)})
    got = [tuple(r.values()) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(got) == taken(files.read_sam(spark, sam_twin(tmp_path / "b.sam", rows)))


def _write_here(rows, path):
    from pyspark.sql import Row

    names = ["name", "flag", "contig", "pos", "mapq", "cigar", "tlen", "seq"]
    ordered = (Row(**dict(zip(names, r))) for r in sorted(rows, key=lambda r: (r[2], r[3])))
    writer = bam.BamWriter({"path": str(path.parent / "parts")}, True)
    part = writer.write(ordered)
    os.rename(path.parent / "parts" / part.path, path)
    os.rename(path.parent / "parts" / f"{part.path}.bai", f"{path}.bai")


def test_split_scan_on_executors(spark, tmp_path):
    rows = reads(6000, seed=2)
    file = written(spark, rows, tmp_path / "c")[0]
    df = bam.read_bam(spark, [file], split_bytes=16 << 10)
    assert df.rdd.getNumPartitions() > 4
    assert taken(df) == taken(files.read_sam(spark, sam_twin(tmp_path / "c.sam", rows)))


def test_region_scan_reads_its_blocks_only(spark, tmp_path):
    rows = reads(20_000, seed=3, span=3_000_000)
    file = written(spark, rows, tmp_path / "d")[0]
    sam = files.read_sam(spark, sam_twin(tmp_path / "d.sam", rows))
    whole = bam.BamReader({"path": file})
    total = sum(1 for p in whole.partitions() for _ in whole.read(p)) and whole.blocks_read
    for begin, end in ((0, 1), (1_000_000, 1_020_000), (2_999_000, 4_000_000), (16384, 32768), (0, 1 << 29)):
        for contigs in (["V1"], ["V0", "V3", "none"], None):
            reader = bam.BamReader({"path": file, "window": f"[{begin}, {end}]", "split_bytes": "30000"} | ({} if contigs is None else {"contigs": str(contigs).replace("'", '"')}))
            got = sorted(tuple(r.values()) for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist())
            overlap = (F.col("ref_start") < end) & (F.greatest("ref_end", F.col("ref_start") + 1) > begin)
            assert got == taken(sam.where(overlap if contigs is None else overlap & F.col("contig").isin(contigs)))
            if contigs == ["V1"] and end < 1_020_001:
                assert reader.blocks_read <= 6 < total
    assert taken(bam.read_bam(spark, [file], contigs=["V2"], window=(5000, 400_000))) == taken(sam.where("contig = 'V2' and ref_start < 400000 and ref_end > 5000"))
    assert bam.read_bam(spark, [file], contigs=["none"]).count() == 0


def test_every_faulty_index_is_named(spark, tmp_path):
    rows = reads(300, seed=4)
    paths = []
    for name in ("good", "old", "missing", "other", "broken"):
        _write_here([r for r in rows if name != "other" or r[2] != "V1"], tmp_path / f"{name}.bam")
        paths.append(str(tmp_path / f"{name}.bam"))
    bam.check_indexes(paths[:1])
    os.utime(tmp_path / "old.bam.bai", (1, 1))
    os.remove(tmp_path / "missing.bam.bai")
    (tmp_path / "other.bam.bai").write_bytes((tmp_path / "good.bam.bai").read_bytes())
    (tmp_path / "broken.bam.bai").write_bytes(b"BAI\1\7\0")
    with pytest.raises(ValueError) as error:
        bam.check_indexes(paths)
    assert all(name in str(error.value) for name in ("old.bam", "missing.bam", "other.bam", "broken.bam")) and "good.bam" not in str(error.value)
    with pytest.raises(Exception, match="no index"):
        bam.BamReader({"path": paths[2], "contigs": '["V0"]'}).partitions()


def test_faulty_files(spark, tmp_path):
    _write_here(reads(500, seed=5), tmp_path / "e.bam")
    raw = bytearray((tmp_path / "e.bam").read_bytes())
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) // 2])
    raw[len(raw) // 2] ^= 255
    (tmp_path / "flipped.bam").write_bytes(raw)
    (tmp_path / "text.bam").write_text("no BAM file")
    for name in ("cut", "flipped", "text"):
        reader = bam.BamReader({"path": str(tmp_path / f"{name}.bam")})
        with pytest.raises(Exception):
            [list(reader.read(p)) for p in reader.partitions()]
    with pytest.raises(FileNotFoundError):
        bam.BamReader({"path": str(tmp_path / "none.bam")}).partitions()


def test_empty_and_unmapped(spark, tmp_path):
    _write_here([], tmp_path / "f.bam")
    assert bam.read_bam(spark, [str(tmp_path / "f.bam")]).count() == 0
    unsorted = [("a", 0, "V0", 9, 0, "4M", 0, "ACGT"), ("b", 0, "V0", 3, 0, "4M", 0, "ACGT")]
    with pytest.raises(Exception, match="sorted"):
        spark.createDataFrame(unsorted, ROWS).coalesce(1).write.format("bam").mode("overwrite").save(str(tmp_path / "g"))


def test_written_from_batches(spark, tmp_path):
    """Spark hands the writer Arrow batches, and a CIGAR is parsed once for all reads that have it."""
    bam._operations.cache_clear()
    assert bam._operations("5S10M2I3D") == (4, struct.pack("<4I", 5 << 4 | 4, 10 << 4, 2 << 4 | 1, 3 << 4 | 2), 13)
    assert bam._operations("5S10M2I3D") and bam._operations.cache_info().hits == 1
    assert isinstance(bam.BamSource({"path": str(tmp_path)}).writer(None, True), DataSourceArrowWriter)
    rows = [(f"r{i}", 0, f"c{i % 3}", i, 60, "10M2S", 7, "ACGTA" if i % 2 else "*") for i in range(50)]
    bam.write_bam(spark.createDataFrame(rows, "name string, flag int, contig string, pos int, mapq int, cigar string, tlen int, seq string"), f"{tmp_path}/b")
    got = sorted((r.contig, r.ref_start, r.ref_end, r.mapq, r.tlen, r.qlen, r.qalen) for r in bam.read_bam(spark, [f"{tmp_path}/b"]).collect())
    assert got == sorted((c, p, p + 10, 60, 7, 5 if i % 2 else 12, 10) for i, (_, _, c, p, *_) in enumerate(rows))


def test_a_window_is_no_task_a_contig(spark, tmp_path):
    rows = [(f"r{i}", 0, f"c{i % 40:02}", i // 40 * 500, 60, "100M", 7, "*") for i in range(40 * 400)]
    rows.sort(key=lambda r: (r[2], r[3]))
    part = bam.BamWriter({"path": str(tmp_path)}, True).write(iter(rows))
    reader = bam.BamReader({"path": f"{tmp_path}/{part.path}", "window": "[40000, 45000]"})
    pieces = reader.partitions()
    got = sorted((c, p) for piece in pieces for b in reader.read(piece) for c, p in zip(b.column("contig").to_pylist(), b.column("ref_start").to_pylist()))
    assert got == sorted((c, p) for _, _, c, p, *_ in rows if p < 45000 and p + 100 > 40000)
    assert len(pieces) == 1
