import os

import numpy as np
import pytest

from helixbin.plans.cli import main, parser
from helixbin.plans.config import Config
from helixbin.sources import bam, files


def test_config_round_trip(tmp_path):
    c = Config(output=str(tmp_path), fragment_length=10, fragment_step=2, wsize=4, wstep=2)
    assert c.input_shapes(2) == {"coverage": (4, 2), "composition": (136,)}
    c.save()
    assert Config.load(str(tmp_path / "config.json"), kmer=5).kmer == 5
    assert Config().fragment_length == 1024
    with pytest.raises(ValueError):
        Config(algorithm="spectral")
    assert parser().parse_args(["run", "--theta", "0.7"]).theta == 0.7


def test_fasta_and_sam(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">V0 first\nACGT\nacgt\n>V1\nNNA\n>V2\n")
    got = {r.contig: r.seq for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"V0": "ACGTacgt", "V1": "NNA", "V2": ""} and files.count_fasta(spark, str(tmp_path / "a.fasta")) == 3
    with pytest.raises(NotImplementedError):
        files.read_fasta(spark, "a.txt")
    (tmp_path / "a.sam").write_text("@SQ\tSN:V0\nr\t0\tV0\t3\t60\t2S5M1D3M\t*\t0\t-90\tACGTACGTAC\t*\nq\t0\tV0\t1\t60\t4M\t*\t0\t0\t*\t*\n")
    rows = files.read_sam(spark, str(tmp_path / "a.sam"), 1).orderBy("ref_start").collect()
    assert [(r.ref_start, r.ref_end, r.qlen, r.qalen, r.tlen) for r in rows] == [(0, 4, 4, 4, 0), (2, 11, 10, 8, -90)]
    files.write_bins(spark.createDataFrame([("V0", 3)], "contig string, bin long"), str(tmp_path / "bins"))
    assert files.read_bins(spark, str(tmp_path / "bins")).first().bin == 3


def test_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    genomes = [rng.dirichlet(np.ones(4) * 2) for _ in range(2)]
    with open(tmp_path / "a.fasta", "w") as f, open(tmp_path / "0.sam", "w") as s0, open(tmp_path / "1.sam", "w") as s1:
        for c in range(6):
            seq = "".join(rng.choice(list("ACGT"), 400, p=genomes[c % 2]))
            f.write(f">V{c}\n{seq}\n")
            for out, depth in ((s0, 8 if c % 2 else 2), (s1, 3)):
                for k in range(depth * 8):
                    at = int(rng.integers(0, 350))
                    out.write(f"r{k}\t0\tV{c}\t{at + 1}\t60\t50M\t*\t0\t100\t{seq[at:at + 50]}\t*\n")
        f.write(">tiny\nACGT\n")
    options = dict(fasta=str(tmp_path / "a.fasta"), alignments=[str(tmp_path / f"{i}.sam") for i in (0, 1)], output=str(tmp_path / "out"), min_ctg_len=100, fragment_length=64, fragment_step=16, n_train=64, n_test=8, batch_size=8, test_batch=4, n_frags=4, compo_neurons=[8, 4], cover_neurons=[8, 4], cover_filters=2, cover_kernel=3, cover_stride=2, merge_neurons=2, wsize=8, wstep=4, theta=0.1, test_ratio=0.34, recruit_small_contigs=True)
    bins = main([], spark, **options)
    assert {r.contig for r in bins.collect()} <= {f"V{c}" for c in range(6)} and bins.count() >= 4
    first = sorted(map(tuple, bins.collect()))
    for name in ("assembly-filtered", "exclude", "dtr", "coverage", "pairs-train", "latent", "pre_graph", "nn-test", "bins_0.1-0.3-0.4", "helixbin.log", "config.json"):
        assert os.path.exists(tmp_path / "out" / name), name
    again = main(["cluster"], spark, output=str(tmp_path / "out"), resume=True)
    assert sorted(map(tuple, again.collect())) == first


def test_bam_gives_the_coverage_of_sam(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"r{k}", int(rng.choice([0, 16, 1024])), f"V{rng.integers(4)}", int(rng.integers(0, 350)), int(rng.integers(20, 61)), str(rng.choice(["50M", "20M2D30M", "40M10S", "10S40M"])), 100, "*") for k in range(600)]
    with open(tmp_path / "a.fasta", "w") as f, open(tmp_path / "a.sam", "w") as s:
        for c in range(4):
            seq = rng.choice(list("ACGTN"), 410)
            f.write(f">V{c}\n{''.join(seq)}\n")
        for name, flag, contig, pos, mapq, cigar, tlen, seq in rows:
            s.write(f"{name}\t{flag}\t{contig}\t{pos + 1}\t{mapq}\t{cigar}\t*\t0\t{tlen}\t{seq}\t*\n")
    bam.write_bam(spark.createDataFrame(rows, "name string, flag int, contig string, pos int, mapq int, cigar string, tlen int, seq string"), str(tmp_path / "a"))
    got = []
    for name in ("a.sam", "a"):
        options = dict(fasta=str(tmp_path / "a.fasta"), alignments=[str(tmp_path / name)] * 2, output=str(tmp_path / f"out-{name}"), min_ctg_len=100)
        got.append(sorted(map(tuple, main(["preprocess"], spark, **options)["coverage"].select("contig", "sample", "depth").collect())))
    assert got[0] == got[1] and len(got[0]) == 8 and sum(map(sum, (r[2] for r in got[0]))) > 1000
    os.remove(next(p for p in (tmp_path / "a").iterdir() if p.name.endswith(".bai")))
    with pytest.raises(ValueError, match="no index"):
        main(["preprocess"], spark, **options | {"output": str(tmp_path / "none")})


def test_files_of_preprocessing(spark, tmp_path):
    """Filtered FASTA, repeats and exclusions as text, without the contigs of an id file; other letters raise."""
    rng = np.random.default_rng(4)
    random = lambda n: "".join(rng.choice(list("ACGT"), n))
    end = random(40)
    seqs = {"V0": end + random(500) + end, "V1": random(300) + "n" * 5 + random(300), "gone": end + random(300) + end, "tiny": "ACGTN"}
    (tmp_path / "a.fasta").write_text("".join(f">{k} note\n{v[:50]}\n{v[50:]}\n" for k, v in seqs.items()))
    (tmp_path / "ids.txt").write_text("gone because\n\n  absent\tx\n")
    main(["preprocess"], spark, fasta=str(tmp_path / "a.fasta"), exclude_ids=str(tmp_path / "ids.txt"), features=["composition"], output=str(tmp_path / "out"), min_ctg_len=100)
    lines = lambda name: sorted("".join(p.read_text() for p in (tmp_path / "out" / name).glob("part-*")).splitlines())
    kept = {k: seqs[k].upper().replace("N", "") for k in ("V0", "V1")}
    assert lines("assembly-filtered.fasta") == sorted(x for k, v in kept.items() for x in (f">{k}", v))
    assert lines("dtr.tsv") == ["V0\t0-39\t260-299"]
    assert lines("exclude") == ["contig\treason\tvalue", "tiny\tlength\t4"]
    (tmp_path / "b.fasta").write_text(f">V0\n{random(200)}E{random(200)}\n")
    with pytest.raises(ValueError, match="V0"):
        main(["preprocess"], spark, fasta=str(tmp_path / "b.fasta"), features=["composition"], output=str(tmp_path / "odd"), min_ctg_len=100)
