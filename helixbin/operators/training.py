"""Inputs of training made on executors, and training there: the driver holds weights, never sequences or vectors.

Pairs are numbered in a pseudo-random order and joined with their fragments' vectors into a table of batches. A round of training
is a job over the next batches: each shard of them is read in order by one task, which takes Adam steps from the state
that it was given, and returns its own; states are averaged. With one shard this is plain training, batch by batch.
"""

from __future__ import annotations

import copy
import logging
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbin.operators import network
from helixbin.operators.embed import kmer_index, kmer_vector, window_means
from helixbin.operators.ranking import ranked
from helixbin.sources.store import materialize

log = logging.getLogger("helixbin")

State = dict[str, np.ndarray]


def fragment_vectors(fragments: DataFrame, features: list[str], k: int = 4, canonical: bool = True, width: int = 64, step: int = 32) -> DataFrame:
    """(contig, f, a column a feature): k-mer counts and smoothed coverage, flattened, of fragments (contig, f, seq, and depth for coverage)."""
    kind = {f.name: f.dataType.simpleString() for f in fragments.schema}
    index = kmer_index(k, canonical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in features:
                if name == "composition":
                    rows = [kmer_vector(s.as_py(), k, index) for s in batch.column("seq")]
                else:
                    rows = [window_means(np.array(d.as_py(), float), width, step).astype(np.float32).ravel() for d in batch.column("depth")]
                columns.append(pa.array([r.tolist() for r in rows], pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([batch.column("contig"), batch.column("f"), *columns], ["contig", "f", *features])

    schema = f"contig {kind['contig']}, f {kind['f']}, " + ", ".join(f"{n} array<float>" for n in features)
    needed = ["contig", "f", *(["seq"] if "composition" in features else []), *(["depth"] if "coverage" in features else [])]
    return fragments.select(*needed).mapInArrow(run, schema)


def numbered_batches(pairs: DataFrame, vectors: DataFrame, features: list[str], batch_size: int, seed: int = 1, remainder: bool = False) -> DataFrame:
    """A table (batch, place, a, i, b, j, label, a_<feature>, b_<feature>) of shuffled pairs (a, i, b, j, label), in order of batches of
    batch_size; the remainder is dropped unless asked for."""
    key = F.struct(F.xxhash64("a", "i", "b", "j", F.lit(seed)).alias("draw"), "a", "i", "b", "j", "label")
    order = ranked(pairs.select(key.alias("key")), "key", "place")
    rows = order.select("key.a", "key.i", "key.b", "key.j", "key.label", "place", F.expr(f"cast(place div {batch_size} as int)").alias("batch"))
    if not remainder:
        rows = rows.where(F.col("batch") < rows.count() // batch_size)
    vectors = materialize(vectors)
    for side, (c, f) in {"a": ("a", "i"), "b": ("b", "j")}.items():
        own = vectors.select(F.col("contig").alias(c), F.col("f").alias(f), *(F.col(n).alias(f"{side}_{n}") for n in features))
        rows = rows.join(own, [c, f])
    names = ["batch", "place", "a", "i", "b", "j", "label", *(f"{s}_{n}" for s in "ab" for n in features)]
    return materialize(rows.select(*names).repartitionByRange("batch").sortWithinPartitions("batch", "place"))


def _batch(table: pa.Table | pa.RecordBatch, shapes: dict[str, tuple[int, ...]]) -> network.Batch:
    def side(s: str) -> dict[str, np.ndarray]:
        out = {}
        for name, shape in shapes.items():
            column = table.column(f"{s}_{name}")
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            out[name] = x if len(shape) == 1 else x.reshape(len(column), shape[1], shape[0])  # a row a sample
        return out

    return side("a"), side("b"), table.column("label").to_numpy().astype(float)


def read_batches(table: DataFrame, shapes: dict[str, tuple[int, ...]], load_batch: int = 100) -> Iterator[network.Batch]:
    """The batches in order, load_batch of them in memory at a time."""
    last = table.agg(F.max("batch")).first()[0]
    for lo in range(0, -1 if last is None else last + 1, load_batch):
        rows = table.where(F.col("batch").between(lo, lo + load_batch - 1)).toArrow()
        number = rows.column("batch").to_numpy()
        order = np.lexsort((rows.column("place").to_numpy(), number))
        for own in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(own):
                yield _batch(rows.take(pa.array(own)), shapes)


def _step(model: network.Model, state: State, batch: network.Batch, learning_rate: float) -> None:
    """One step of Adam; the state holds both moments of each weight and the number of steps."""
    _, grads = model.gradients(*batch)
    state["steps"] = state["steps"] + 1
    t = float(state["steps"])
    for k, v in model.parameters().items():
        m1, m2 = state[f"1.{k}"], state[f"2.{k}"]
        m1[...] = 0.9 * m1 + 0.1 * grads[k]
        m2[...] = 0.999 * m2 + 0.001 * grads[k] ** 2
        v -= learning_rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)


def _shard_runner(shared, shapes: dict[str, tuple[int, ...]], learning_rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = state = shard = None
        waiting: pa.Table | None = None

        def result() -> pa.RecordBatch:
            every = state | {f"0.{k}": v for k, v in model.parameters().items()}
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(every), pa.int32()), pa.array(list(every)), pa.array([np.asarray(v, np.float64).tobytes() for v in every.values()], pa.binary())], ["shard", "name", "value"])

        def take(rows: pa.Table):
            nonlocal model, state, shard
            own = rows.column("shard")[0].as_py()
            done = result() if shard is not None and own != shard else None
            if own != shard:
                (model, state), shard = copy.deepcopy(shared.value), own
            _step(model, state, _batch(rows, shapes), learning_rate)
            return done

        for part in arrow:
            rows = pa.Table.from_batches([part])
            if waiting is not None:
                rows = pa.concat_tables([waiting, rows])
            if not len(rows):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(rows.column("batch").to_numpy())) + 1), len(rows)]
            for lo, hi in zip(cuts[:-2], cuts[1:-1]):
                if (out := take(rows.slice(lo, hi - lo))) is not None:
                    yield out
            waiting = rows.slice(cuts[-2])  # its batch may go on
        if waiting is not None and len(waiting):
            if (out := take(waiting)) is not None:
                yield out
        if shard is not None:
            yield result()

    return run


def predicted(table: DataFrame, model: network.Model, shapes: dict[str, tuple[int, ...]]) -> DataFrame:
    """(place, a, b, label, a probability a head) of a table of batches, on executors."""
    heads = [*shapes, *(["combined"] if len(shapes) > 1 else [])]
    shared = table.sparkSession.sparkContext.broadcast(model)
    kept = ["place", "a", "b", "label"]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            if len(part):
                a, b, _ = _batch(part, shapes)
                p = shared.value.forward(a, b)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(p[h].astype(float)) for h in heads)], [*kept, *heads])

    kind = {f.name: f.dataType.simpleString() for f in table.schema}
    return table.mapInArrow(run, ", ".join([*(f"{c} {kind[c]}" for c in kept), *(f"{h} double" for h in heads)]))


def test_loss(table: DataFrame, model: network.Model, shapes: dict[str, tuple[int, ...]]) -> float:
    head = "combined" if len(shapes) > 1 else next(iter(shapes))
    clamp = lambda c: F.greatest(F.when(c > 0, F.log(c)).otherwise(-100.0), F.lit(-100.0))
    p, y = F.col(head), F.col("label")
    return predicted(table, model, shapes).agg(F.avg(-(y * clamp(p) + (1 - y) * clamp(1 - p)))).first()[0]


def train(model: network.Model, table: DataFrame, test: DataFrame, shapes: dict[str, tuple[int, ...]], learning_rate: float = 1e-3, test_batch: int = 400, patience: int = 5, shards: int = 1) -> list[float]:
    """One epoch over the batches of a table, a job for every test_batch of them; then the test loss is taken, the best weights are
    kept, and training stops when the oldest of the last patience losses is the least. Returns the losses."""
    sc = table.sparkSession.sparkContext
    state: State = {f"{m}.{k}": np.zeros_like(v, float) for m in (1, 2) for k, v in model.parameters().items()} | {"steps": np.zeros(())}
    n = (table.agg(F.max("batch")).first()[0] + 1) if not table.isEmpty() else 0
    losses: list[float] = []
    last: deque[float] = deque(maxlen=patience)
    best: State | None = None
    for lo in range(0, n, test_batch):
        rows = table.where(F.col("batch").between(lo, min(n, lo + test_batch) - 1)).withColumn("shard", F.col("batch") % shards)
        rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "batch", "place")
        shared = sc.broadcast((model, state))
        found = rows.mapInArrow(_shard_runner(shared, shapes, learning_rate), "shard int, name string, value binary").collect()  # shards times the network's size
        parts: dict[str, list[np.ndarray]] = {}
        for r in found:
            parts.setdefault(r["name"], []).append(np.frombuffer(bytes(r["value"])))
        for name in state:
            state[name] = np.mean(parts[name], axis=0).reshape(state[name].shape)
        for k, v in model.parameters().items():
            v[...] = np.mean(parts[f"0.{k}"], axis=0).reshape(v.shape)
        shared.destroy()
        loss = test_loss(test, model, shapes)
        log.info("batches to %d: test loss %.5f", min(n, lo + test_batch), loss)
        if not losses or loss <= min(losses):
            best = {k: v.copy() for k, v in model.parameters().items()}
        losses.append(loss)
        last.append(loss)
        if len(last) == patience and last[0] == min(last):
            break
    if best:
        for k, v in model.parameters().items():
            v[...] = best[k]
    return losses
