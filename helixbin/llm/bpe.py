"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern; the adjacent parts of least rank of each distinct piece are merged
until no pair has a rank. Decoding looks up the bytes of each id and concatenates them.

``with_tokens_native`` is the method with Spark higher-order functions: a fold merges the parts of distinct words over
a literal rank map, dealt into buckets by hash because Spark searches a map from its start. It gives the same results,
but interpreted lambdas take several times the CPU seconds allowed (README.md has the figures), so ``with_tokens`` does
the same work in Arrow batches: a worker folds each distinct word it meets once and keeps a bounded number of them.
No text is exploded or shuffled; only the vocabulary, a file of fixed size, is broadcast.

Defined results: null text is empty and has no ids; rows are encoded singly, so repeated rows have equal results;
texts are encoded whole, without special tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct words whose encodings a worker keeps, and buckets of the literal rank map.
WORDS_KEPT, RANK_BUCKETS = 1 << 18, 16384


@dataclass(frozen=True)
class Vocabulary:
    ranks: tuple[bytes, ...]
    pattern: str

    @staticmethod
    @lru_cache
    def read(path: str, pattern: str) -> Vocabulary:
        """From a file of lines "base64 rank"; ranks must be 0, 1, 2, ..."""
        with open(path, "rb") as f:
            pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        if [r for r, _ in pairs] != list(range(len(pairs))):
            raise ValueError("ranks are not consecutive")
        return Vocabulary(tuple(t for _, t in pairs), pattern)

    def jvm_pattern(self) -> str:
        return "(?U)" + self.pattern


def _literal(value: object, schema: str) -> Column:
    """A constant of any size, which the optimizer folds once."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def _bucket_of(text: Column, buckets: int) -> Column:
    return F.pmod(F.hash(text), F.lit(buckets)) + 1


def _bucketed(spark, entries: dict[str, object], buckets: int) -> list[dict[str, object]]:
    """Entries by the bucket that Spark's hash gives their keys."""
    keys = list(entries)
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", _bucket_of(F.col("k"), buckets).alias("b"))
    out: list[dict[str, object]] = [{} for _ in range(buckets)]
    for k, b in got.toLocalIterator():
        out[b - 1][k] = entries[k]
    return out


class Encoder:
    """Expressions that encode and decode a text column by a vocabulary."""

    def __init__(self, spark, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.spark = spark
        hexes = [t.hex() for t in vocabulary.ranks]
        self.rank_map = _literal(_bucketed(spark, {h: i for i, h in enumerate(hexes)}, RANK_BUCKETS), "array<map<string,int>>")
        self.token_hex = _literal(hexes, "array<string>")
        self.id_hex = _literal([i.to_bytes(4, "little").hex() for i in range(len(hexes))], "array<string>")

    def rank(self, part: Column) -> Column:
        """Rank of a part, or null."""
        return F.try_element_at(F.element_at(self.rank_map, _bucket_of(part, RANK_BUCKETS)), part)

    def pieces(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.vocabulary.jvm_pattern()), F.lit(0))

    def merged(self, piece: Column) -> Column:
        """The piece's parts after all ranked merges; ranks[i] belongs to parts i and i + 1."""
        whole = F.lower(F.hex(F.encode(piece, "UTF-8")))
        n = F.length(whole) / 2

        def let(value: Column, body) -> Column:
            return F.element_at(F.transform(F.array(value), body), 1)

        def step(state: Column, _: Column) -> Column:
            return F.when(F.array_min(state["ranks"]).isNull(), state).otherwise(let(F.array_position(state["ranks"], F.array_min(state["ranks"])).cast("int"), lambda i: merge(state["parts"], state["ranks"], i)))

        def merge(parts: Column, ranks: Column, i: Column) -> Column:
            return let(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1)), lambda new: F.struct(
                F.concat(F.slice(parts, 1, i - 1), F.array(new), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                F.concat(
                    F.when(i > 1, F.concat(F.slice(ranks, 1, i - 2 + F.when(i == 1, 1).otherwise(0)), F.array(self.rank(F.concat(F.element_at(parts, F.greatest(i - 1, F.lit(1))), new))))).otherwise(F.array().cast("array<int>")),
                    F.when(i + 1 < F.size(parts), F.array(self.rank(F.concat(new, F.try_element_at(parts, i + 2))))).otherwise(F.array().cast("array<int>")),
                    F.slice(ranks, i + 2, F.size(parts)),
                ).alias("ranks"),
            ))

        parts = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.substring(whole, 2 * k + 1, F.lit(2)))
        start = let(parts, lambda ps: F.struct(ps.alias("parts"), F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda p, k: self.rank(F.concat(p, F.element_at(ps, k + 2)))).alias("ranks")))
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), start, step, lambda s: s["parts"])
        return F.when(self.rank(whole).isNotNull(), F.array(whole)).otherwise(folded)

    def coded(self, piece: Column) -> Column:
        """(ids, bytes) of a piece in hexadecimal: its ids, and what decoding them gives."""
        ids = F.transform(self.merged(piece), self.rank)
        return F.element_at(F.transform(F.array(ids), lambda v: F.struct(
            F.array_join(F.transform(v, lambda i: F.element_at(self.id_hex, i + 1)), "").alias("ids"),
            F.array_join(F.transform(v, lambda i: F.element_at(self.token_hex, i + 1)), "").alias("bytes"),
        )), 1)

    def text_coded(self, text: Column) -> Column:
        """Array of (ids, bytes) of the text's pieces: each distinct piece of the text is folded once."""
        words = F.array_distinct(self.pieces(text))
        coded = F.map_from_arrays(words, F.transform(words, self.coded))
        return F.transform(self.pieces(text), lambda p: F.element_at(coded, p))


def with_tokens_native(docs: DataFrame, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """As with_tokens, with higher-order functions only."""
    encoder = Encoder(docs.sparkSession, vocabulary)
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), encoder.text_coded(F.col("text")).alias("c"))
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*kept, F.unhex(F.array_join("c.ids", "")).alias("ids"), F.unhex(F.array_join("c.bytes", "")).alias("decoded"))


class Words(dict):
    """Encodings (little-endian ids) of distinct words, folded when first met; forgets all when full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = b"".join(self.ranks[p].to_bytes(4, "little") for p in merged_parts(word.encode(), self.ranks))
        self[word] = ids
        return ids


def merged_parts(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Parts of a word after its pairs of least rank, leftmost first, are merged until no pair has a rank.

    Short words, nearly all, are rescanned after a merge; long ones keep their pairs in a heap."""
    if word in ranks:
        return [word]
    if len(word) > 64:
        return _merged_by_heap(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return parts


def _merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    end = {i: i + 1 for i in range(len(word))}  # a part by its first byte
    before = {i: i - 1 for i in range(len(word))}
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < len(word) and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, k = heapq.heappop(heap)
        if i not in end or end[i] == k or end.get(end[i]) != k:
            continue  # one of the two has been merged since
        j = end[i]
        del end[j], before[j]
        end[i] = k
        if k < len(word):
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [word[i:j] for i, j in sorted(end.items())]


def decoded_bytes(ids: np.ndarray, tokens: tuple[bytes, ...]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def with_tokens(docs: DataFrame, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """The columns keep of docs (text), ids (binary, little-endian unsigned 32-bit integers) and decoded (binary)."""
    return _mapped(docs, keep, vocabulary, [("ids", "binary", pa.binary()), ("decoded", "binary", pa.binary())], lambda ids, raw: (ids, raw))


def with_token_digests(docs: DataFrame, keep: list[str], vocabulary: Vocabulary) -> DataFrame:
    """The columns keep of docs (text), n_tokens and SHA-256 digests of ids and decoded bytes, made where these are."""
    kinds = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, keep, vocabulary, kinds, lambda ids, raw: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))


def _mapped(docs: DataFrame, keep: list[str], vocabulary: Vocabulary, kinds, result) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), *(f"{n} {k}" for n, k, _ in kinds)])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pattern = shared.value
        cut = regex.compile(pattern).findall
        words = Words({t: i for i, t in enumerate(tokens)})
        for batch in batches:
            rows = []
            for text in batch.column(0):
                ids = b"".join(map(words.__getitem__, cut(text.as_py() or "")))
                rows.append(result(ids, decoded_bytes(np.frombuffer(ids, "<u4"), tokens)))
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, k) for c, (_, _, k) in zip(columns, kinds))], names=[*keep, *(n for n, _, _ in kinds)])

    return docs.selectExpr("text AS _text", *(f"`{c}`" for c in keep)).mapInArrow(run, schema)
