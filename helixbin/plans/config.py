"""Options of the workflow, their defaults, and the settings file."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

#: File names of the stages' results.
NAMES = {
    "contigs": "assembly-filtered", "filtered_fasta": "assembly-filtered.fasta", "exclude": "exclude", "dtr": "dtr", "dtr_text": "dtr.tsv", "coverage": "coverage", "train": "pairs-train", "test": "pairs-test",
    "model": "model.npz", "predictions": "nn-test", "latent": "latent", "pre_graph": "pre_graph", "recruits": "recruits",
}


@dataclass
class Config:
    output: str = "output"
    fasta: str | None = None
    coverage: str | None = None
    alignments: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=lambda: ["coverage", "composition"])
    resume: bool = False
    min_ctg_len: int = 2048
    min_prevalence: int = 2
    min_mapping_quality: int = 30
    min_aln_coverage: float = 50
    flag: int = 3596
    tlen_range: list[int] | None = None
    min_dtr_size: int = 10
    fragment_length: int = -1
    fragment_step: int = 128
    test_ratio: float = 0.1
    n_train: int = 4_000_000
    n_test: int = 10_000
    learning_rate: float = 1e-3
    batch_size: int = 256
    test_batch: int = 400
    patience: int = 5
    load_batch: int = 100
    shards: int = 1
    exclude_ids: str | None = None
    compo_neurons: list[int] = field(default_factory=lambda: [64, 32])
    cover_neurons: list[int] = field(default_factory=lambda: [64, 32])
    cover_filters: int = 16
    cover_kernel: int = 4
    cover_stride: int = 2
    merge_neurons: int = 32
    kmer: int = 4
    no_rc: bool = False
    wsize: int = 64
    wstep: int = 32
    n_frags: int = 30
    max_neighbors: int = 250
    vote_threshold: float | None = None
    algorithm: str = "leiden"
    theta: float = 0.8
    gamma1: float = 0.3
    gamma2: float = 0.4
    n_clusters: int | None = None
    recruit_small_contigs: bool = False
    include_complete: bool = False
    radius_scale: float = 1.0
    compat: bool = False
    seed: int = 1

    def __post_init__(self) -> None:
        unknown = set(self.features) - {"coverage", "composition"}
        if unknown or not self.features:
            raise ValueError("features are coverage, composition, or both")
        if self.algorithm not in ("leiden", "spectral"):
            raise ValueError("the algorithm is leiden or spectral")
        if self.algorithm == "spectral" and not self.n_clusters:
            raise ValueError("spectral communities need n_clusters")
        if self.fragment_length < 0:
            self.fragment_length = max(1024, self.min_ctg_len // 2)
        self.fragment_length = self.fragment_length // self.fragment_step * self.fragment_step

    def path(self, name: str) -> str:
        return f"{self.output}/{NAMES[name]}"

    @property
    def bins(self) -> str:
        return f"{self.output}/bins_{self.theta}-{self.gamma1}-{self.gamma2}"

    @property
    def graph(self) -> str:
        return f"{self.output}/graph_{self.theta}-{self.gamma1}-{self.gamma2}"

    def input_shapes(self, n_samples: int) -> dict[str, tuple[int, ...]]:
        """Width of the network's inputs: k-mers, and smoothed windows by samples."""
        from helixbin.functions.sequence import kmer_total

        windows = -(-(self.fragment_length - self.wsize + 1) // self.wstep)
        every = {"composition": (kmer_total(self.kmer, not self.no_rc),), "coverage": (windows, n_samples)}
        return {f: every[f] for f in self.features}

    def save(self, path: str | None = None) -> None:
        p = Path(path or f"{self.output}/config.json")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(dataclasses.asdict(self), indent=1))

    @staticmethod
    def load(path: str, **changes) -> Config:
        """Settings of an earlier run, with changes; the output is where the file lies."""
        found = json.loads(Path(path).read_text()) | {"output": str(Path(path).parent)}
        names = {f.name for f in dataclasses.fields(Config)}
        return Config(**{k: v for k, v in (found | changes).items() if k in names})
