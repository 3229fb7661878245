"""The workflow: preprocess, learn, cluster. Stages are Parquet tables under the output folder; resume skips complete ones."""

from __future__ import annotations

import logging
import os
import resource

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.functions import sequence as S
from helixbin.operators import alignments as A
from helixbin.operators import embed, graph, latent, network, pairs, recruit, repeats, training
from helixbin.plans.config import Config
from helixbin.sources import bam, files
from helixbin.sources.store import exists, materialize, stage

log = logging.getLogger("helixbin")


def setup_logging(path: str, level: int = logging.INFO) -> None:
    """Messages with the driver's peak memory, to the console and a file."""

    class Memory(logging.Filter):
        def filter(self, record: logging.LogRecord) -> bool:
            record.memory = f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6:.2f} GB"
            return True

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    log.handlers.clear()
    for handler in (logging.StreamHandler(), logging.FileHandler(path)):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(memory)s] %(message)s"))
        handler.addFilter(Memory())
        log.addHandler(handler)
    log.setLevel(level)


def preprocess(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """Filtered contigs, terminal repeats, exclusions, and dense coverage (contig, sample, depth) of the valid bases."""
    if not cfg.fasta:
        raise ValueError("preprocess needs a FASTA file")
    raw = files.read_fasta(spark, cfg.fasta)
    judged = A.by_length(raw, cfg.min_ctg_len)
    kept = judged.where("kept").select("contig", "seq", "length")
    if cfg.exclude_ids:
        kept = A.without_ids(kept, files.read_ids(spark, cfg.exclude_ids))
    out = {"contigs": stage(spark, cfg.path("contigs"), lambda: kept, cfg.resume)}
    files.check_alphabet(out["contigs"])
    excluded = judged.where("NOT kept").select("contig", F.lit("length").alias("reason"), F.col("length").cast("string").alias("value"))
    out["dtr"] = stage(spark, cfg.path("dtr"), lambda: repeats.terminal_repeats(out["contigs"], cfg.min_dtr_size), cfg.resume)
    if not (cfg.resume and exists(spark, cfg.path("dtr_text"))):
        files.write_repeats(out["dtr"], out["contigs"], cfg.path("dtr_text"))
    if not (cfg.resume and exists(spark, cfg.path("filtered_fasta"))):
        files.write_fasta(out["contigs"], cfg.path("filtered_fasta"))
    if "coverage" in cfg.features:
        if cfg.coverage:
            cover = spark.read.parquet(cfg.coverage)
        elif cfg.alignments:
            tests = A.predicates(cfg.min_mapping_quality, cfg.min_aln_coverage, cfg.flag, tuple(cfg.tlen_range) if cfg.tlen_range else None)
            bam.check_indexes([p for p in cfg.alignments if bam.is_bam(p)])
            reads = files.read_samples(spark, cfg.alignments)
            for row in A.counters(reads, ["sample"], tests).orderBy("sample").collect():  # one row a sample
                log.info("reads of sample %s: %s", row["sample"], row.asDict())
            covered = A.runs(A.spans(reads.where(A.accepted(tests, cfg.compat)), cfg.compat), ["contig", "sample"])
            valid = raw.join(out["contigs"].select("contig"), "contig", "left_semi")
            covered = materialize(A.masked_runs(covered, valid))
            lengths = out["contigs"].select("contig", "length")
            gone = materialize(A.exclusions(A.totals(covered), lengths, list(range(len(cfg.alignments))), cfg.min_prevalence))
            excluded = excluded.unionByName(gone)
            every = A.without_ids(lengths, gone).select("contig", "length", F.explode(F.sequence(F.lit(0), F.lit(len(cfg.alignments) - 1))).alias("sample"))
            cover = A.zero_filled(covered, every, ["contig", "sample"])
        else:
            raise ValueError("coverage needs alignments or a coverage table")
        cover = stage(spark, cfg.path("coverage"), lambda: cover, cfg.resume)
        both = A.synchronized(out["contigs"], cover).where("side = 'both'").select("contig")
        out["contigs"] = out["contigs"].join(both, "contig", "left_semi")
        out["coverage"] = cover.join(both, "contig", "left_semi")
    if not (cfg.resume and exists(spark, cfg.path("exclude"))):
        files.write_exclusions(excluded, cfg.path("exclude"))
    return out


def _load(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    out = {"contigs": files.check_table(spark, cfg.path("contigs"))}
    if "coverage" in cfg.features:
        out["coverage"] = files.check_table(spark, cfg.path("coverage"))
        out["contigs"] = out["contigs"].join(out["coverage"].select("contig").distinct(), "contig", "left_semi")
    return out


def model_of(cfg: Config, n_samples: int) -> network.Model:
    shapes = cfg.input_shapes(n_samples)
    make = {
        "composition": lambda s: network.Branch(s, tuple(cfg.compo_neurons), seed=cfg.seed),
        "coverage": lambda s: network.Branch(s, tuple(cfg.cover_neurons), cfg.cover_filters, cfg.cover_kernel, cfg.cover_stride, cfg.seed + 1),
    }
    return network.Model({f: make[f](s) for f, s in shapes.items()}, cfg.merge_neurons, cfg.seed)


def make_pairs(spark: SparkSession, cfg: Config, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test pairs (a, i, b, j, label); half of each are positive; no test contig is trained on."""
    if contigs.where(F.length("seq") < cfg.min_ctg_len).limit(1).count():
        raise RuntimeError("contigs below the least length: run preprocess first")
    usable = contigs.where(F.length("seq") > 2 * cfg.fragment_length)
    frags = materialize(usable.select("contig", S.fragment_count(F.length("seq"), cfg.fragment_length, cfg.fragment_step).alias("n")).where("n > 0"))
    named = frags.select(F.xxhash64("contig").alias("contig"), F.col("contig").alias("name"), "n")
    parts = pairs.split_test(named, cfg.test_ratio, cfg.seed)

    def drawn(test: bool, n: int) -> DataFrame:
        own = materialize(named.join(parts.where(F.col("test") == test), "contig", "left_semi"))
        fppc = -(-(n // 2) // max(1, own.count()))
        pos = pairs.some_of(pairs.positive_pairs(own, fppc, cfg.seed), n // 2, cfg.seed).select(F.col("contig").alias("a"), "i", F.col("contig").alias("b"), "j")
        neg = pairs.negative_pairs(own, n // 2, cfg.seed).select("a", "i", "b", "j")
        both = pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
        a, b = named.select(F.col("contig").alias("a"), F.col("name").alias("na")), named.select(F.col("contig").alias("b"), F.col("name").alias("nb"))
        return both.join(a, "a").join(b, "b").select(F.col("na").alias("a"), "i", F.col("nb").alias("b"), "j", "label").orderBy(F.xxhash64("a", "i", "b", "j", F.lit(cfg.seed)))

    train = stage(spark, cfg.path("train"), lambda: drawn(False, cfg.n_train), cfg.resume)
    return train, stage(spark, cfg.path("test"), lambda: drawn(True, cfg.n_test), cfg.resume)


def fragment_inputs(cfg: Config, data: dict[str, DataFrame], drawn: DataFrame) -> DataFrame:
    """(contig, f, seq, depth) of the distinct fragments of drawn pairs."""
    sides = drawn.select(F.col("a").alias("contig"), F.col("i").alias("f")).union(drawn.select("b", "j")).distinct()
    at = F.col("f") * cfg.fragment_step
    rows = sides.join(data["contigs"].select("contig", "seq"), "contig").select("contig", "f", F.substring("seq", at + 1, F.lit(cfg.fragment_length)).alias("seq"))
    if "coverage" in data:
        cover = data["coverage"].groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "depth"))), lambda x: x["depth"]).alias("depth"))
        rows = rows.join(cover, "contig").withColumn("depth", F.transform("depth", lambda d: F.slice(d, at + 1, F.lit(cfg.fragment_length))))
    return rows


def learn(spark: SparkSession, cfg: Config, data: dict[str, DataFrame] | None = None) -> network.Model:
    """Trains on executors, or with shards = 0 on the driver, which then holds load_batch batches of vectors at a time."""
    data = data or _load(spark, cfg)
    n_samples = data["coverage"].agg(F.max("sample")).first()[0] + 1 if "coverage" in data else 0
    model = model_of(cfg, n_samples)
    if cfg.resume and os.path.exists(cfg.path("model")):
        model.load(cfg.path("model"))
        return model
    train, test = make_pairs(spark, cfg, data["contigs"])
    drawn = train.select("a", "i", "b", "j").union(test.select("a", "i", "b", "j"))
    vectors = materialize(training.fragment_vectors(fragment_inputs(cfg, data, drawn), cfg.features, cfg.kmer, not cfg.no_rc, cfg.wsize, cfg.wstep))
    shapes = cfg.input_shapes(n_samples)
    table = training.numbered_batches(train, vectors, cfg.features, cfg.batch_size, cfg.seed)
    held = training.numbered_batches(test, vectors, cfg.features, cfg.batch_size, cfg.seed, remainder=True)
    if cfg.shards:
        losses = training.train(model, table, held, shapes, cfg.learning_rate, cfg.test_batch, cfg.patience, cfg.shards)
    else:
        losses = network.train(model, lambda: training.read_batches(table, shapes, cfg.load_batch), lambda: training.test_loss(held, model, shapes), cfg.learning_rate, cfg.test_batch, cfg.patience, train.count() // cfg.batch_size)
    rows = materialize(training.predicted(held, model, shapes))
    heads = [c for c in rows.columns if c not in ("place", "a", "b", "label")]
    for head in heads:
        log.info("test losses %s; scores of %s: %s", losses, head, latent.confusion(rows, head, "label").first().asDict())
    model.save(cfg.path("model"))
    files.write_predictions(rows.orderBy("place").select(*heads, F.col("label").cast("int").alias("truth")), cfg.path("predictions"))
    return model


def latents(spark: SparkSession, cfg: Config, model: network.Model, data: dict[str, DataFrame]) -> list[DataFrame]:
    """Latents of each feature in order, coverage first; complete genomes are left out."""
    cover = None
    if "coverage" in data:
        cover = data["coverage"].groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "depth"))), lambda x: x["depth"].cast("array<double>")).alias("depth"))
    dtr = spark.read.parquet(cfg.path("dtr"))
    make = lambda: embed.latents(data["contigs"].select("contig", "seq"), model, cover, cfg.n_frags, cfg.fragment_length, cfg.min_ctg_len, cfg.kmer, not cfg.no_rc, cfg.wsize, cfg.wstep, dtr)
    rows = stage(spark, cfg.path("latent"), make, cfg.resume)
    return [rows.where(F.col("feature") == f).drop("feature") for f in cfg.features]


def cluster(spark: SparkSession, cfg: Config, model: network.Model | None = None, data: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bins (contig, bin) after both passes; they are also written as CSV, and recruits beside them."""
    data = data or _load(spark, cfg)
    if model is None:
        n_samples = data["coverage"].agg(F.max("sample")).first()[0] + 1 if "coverage" in data else 0
        model = model_of(cfg, n_samples)
        model.load(cfg.path("model"))
    features = latents(spark, cfg, model, data)
    names = features[0].select("contig").distinct()
    score = lambda p: latent.score_pairs(p, features, model.combine, cfg.vote_threshold)
    edges = stage(spark, cfg.path("pre_graph"), lambda: score(latent.candidate_pairs(features, cfg.max_neighbors, cfg.radius_scale)), cfg.resume)
    complete = spark.read.parquet(cfg.path("dtr")) if cfg.include_complete else None
    found = graph.refined(names, edges, score, cfg.theta, cfg.n_frags, cfg.gamma1, cfg.gamma2, cfg.algorithm, cfg.n_clusters, complete)
    bins = stage(spark, cfg.graph, lambda: graph.numbered(materialize(found)))
    files.write_bins(bins, cfg.bins)
    if cfg.recruit_small_contigs and cfg.min_ctg_len < 2048 and "coverage" in data:
        depths = data["coverage"].select("contig", "sample", F.explode("depth").alias("depth"))
        lengths = data["contigs"].select("contig", F.length("seq").alias("length"))
        files.write_recruits(recruit.recruits(materialize(recruit.percentile_vectors(depths)), bins, lengths), cfg.path("recruits"))
    return bins


def run(spark: SparkSession, cfg: Config) -> DataFrame:
    setup_logging(f"{cfg.output}/helixbin.log")
    cfg.save()
    preprocess(spark, cfg)
    data = _load(spark, cfg)
    return cluster(spark, cfg, learn(spark, cfg, data), data)
