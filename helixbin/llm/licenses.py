"""License scans: exact containment join of text blocks with license templates; DataFrame functions only.

A block is a line of a text, or any run of a text's words, across lines, that is as long as the template, so that wrapped
notices are found; a template is a short notice with a label. Tokens are ordered by the number of texts of the corpus that hold them,
rarest first. A template is contained in a block when at least THRESHOLD of its distinct tokens stand in the block.

One pass cuts each text into words and keeps, beside their number and the places of the phrases of BASE, the template tokens that the
text holds. These tokens are joined with the first (rarest) tokens of each template: a text whose block contains a template holds one of
them (prefix filter), holds enough tokens (length filter), and has enough left after the first common one (positional filter). Only
the pairs of text and template that pass are verified, block by block; texts without such a pair are not read again.
The templates are a parameter with a checked bound, and so is the vocabulary whose counts reach the driver.

Defined results: null text is empty, with no words, labels or score; rows are judged singly, so repeated rows and
ids have equal results; texts of any length are read whole; an empty table gives an empty result; columns of clashing names are moved
aside and come back as they were.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbin.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices by which a block is recognised; any one of a label's suffices.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Share of a template's distinct tokens that a block must hold; most templates, and most tokens of them together.
THRESHOLD, MAX_TEMPLATES, MAX_VOCABULARY = 0.85, 1000, 20000


#: All ASCII characters that are no letter or digit.
_OTHERS = "".join(chr(b) for b in range(128) if not chr(b).isalnum())


def _spaced(text: Column) -> Column:
    """The text in lower case with a space for each character outside words."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + _OTHERS, LOWER + " " * len(_OTHERS)))


def _words(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def template_tokens(templates) -> list[tuple[str, list[str]]]:
    """(label, distinct tokens) of each template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    fold = str.maketrans(UPPER, LOWER)
    out = [(label, list(dict.fromkeys(re.findall(WORD, text.translate(fold))))) for label, text in templates]
    if len({t for _, ts in out for t in ts}) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} template tokens")
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _stands(words: str, parts: list[str]) -> Callable[[Column], Column]:
    """Whether the parts stand from a place on; element_at counts from 1."""
    return lambda i: reduce(Column.__and__, (F.element_at(words, i + (k + 1)) == p for k, p in enumerate(parts)))


def _cut(docs: DataFrame, keep: list[str], base, tokens: list[str]) -> DataFrame:
    """rid, a number of each row, the columns keep, the text, n_words, held, the tokens in the text, and p0, p1, ..., places of the phrases of base."""
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), "text", _spaced(F.col("text")).alias("_low"))
    rows = rows.select(*(f"_k{i}" for i in range(len(keep))), "text", _words(F.col("_low")).alias("words"))
    rows = rows.select(*(f"_k{i}" for i in range(len(keep))), "text", "words", F.array_intersect("words", _strings(tokens)).alias("held"))
    places = []
    for k, (phrase, _) in enumerate(base):
        parts = phrase.split(" ")
        some = reduce(Column.__and__, (F.array_contains("held", x) for x in parts)) & (F.size("words") >= len(parts))
        found = F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), _stands("words", parts))
        places.append(F.when(some, found).otherwise(F.array().cast("array<int>")).alias(f"p{k}"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), *(f"_k{i}" for i in range(len(keep))), "text", F.size("words").alias("n_words"), "held", *places)


def token_order(rows: DataFrame, tokens: list[str]) -> list[str]:
    """The tokens, those in the fewest texts first; at most MAX_VOCABULARY counts reach the driver."""
    counts = {r["w"]: r["count"] for r in rows.select(F.explode("held").alias("w")).groupBy("w").count().collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _candidates(rows: DataFrame, wanted: list[tuple[int, list[str], int]], order: list[str], threshold: float) -> DataFrame:
    """(rid, text, template, tokens, rare, need, length) of the texts and templates that pass the filters."""
    rank = {t: i for i, t in enumerate(order)}
    entries = []
    for number, ts, length in wanted:
        ts = sorted(ts, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(ts) - 1e-9))
        rare = ts[: len(ts) - need + 1]
        entries += [(t, j, number, ts, rare, need, length) for j, t in enumerate(rare)]
    spark = rows.sparkSession
    prefixes = spark.createDataFrame(entries, "token string, j int, template int, tokens array<string>, rare array<string>, need int, length int")  # within the checked bounds
    sorted_held = rows.where(F.size("held") > 0).select("rid", F.array_intersect(_strings(order), F.col("held")).alias("block"))
    tokens = sorted_held.select("rid", F.size("block").alias("n"), "block", F.posexplode("block").alias("i", "token"))
    pairs = tokens.join(F.broadcast(prefixes), "token").where((F.col("n") >= F.col("need")) & (F.least(F.col("n") - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("need")))
    pairs = pairs.where(F.size(F.array_intersect("block", "tokens")) >= F.col("need")).select("rid", "template", "tokens", "rare", "need", "length").dropDuplicates(["rid", "template"])
    return pairs.join(rows.select("rid", "text"), "rid")


def _verified(pairs: DataFrame) -> DataFrame:
    """(rid, template, share) of the pairs in which a line, or a run of length words, holds need of the tokens; the largest share."""
    pairs = pairs.withColumn("words", _words(_spaced(F.col("text"))))
    by_line = F.transform(F.split("text", "\n"), lambda x: F.size(F.array_intersect("tokens", _words(_spaced(x)))))
    # a run that holds so many tokens holds a rare one, and can be shifted to start with a token
    rare = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("rare", F.element_at("words", i)))
    near = F.array_distinct(F.flatten(F.transform(rare, lambda i: F.sequence(F.greatest(i - F.col("length") + 1, F.lit(1)), i))))
    starts = F.filter(near, lambda i: F.array_contains("tokens", F.element_at("words", i)))
    by_run = F.transform(starts, lambda i: F.size(F.array_intersect("tokens", F.slice("words", i, F.col("length")))))
    most = F.greatest(F.array_max(by_line), F.array_max(by_run))
    # written before it is filtered: a filter would be pushed into the lambdas, words and all
    found = materialize(pairs.select("rid", "template", "need", most.alias("most"), F.size("tokens").alias("n")))
    return found.where("most >= need").select("rid", "template", (F.col("most") / F.col("n")).alias("share"))


def scanned(docs: DataFrame, keep: list[str], base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep of docs (text), n_words, n_base, first_word, last_word, base_labels, labels and score."""
    fold = str.maketrans(UPPER, LOWER)
    named = template_tokens(templates)
    wanted = [(k, ts, len(re.findall(WORD, text.translate(fold)))) for k, ((_, text), (_, ts)) in enumerate(zip(templates, named)) if ts]
    vocabulary = sorted({t for _, ts, _ in wanted for t in ts})
    every_token = sorted({*vocabulary, *(x for phrase, _ in base for x in phrase.split(" "))})
    cut = _cut(docs, keep, base, every_token)
    least = min((max(1, math.ceil(threshold * len(ts) - 1e-9)) for _, ts, _ in wanted), default=1)
    # the text is kept only where some template's number of tokens is reached
    enough = F.size(F.array_intersect("held", _strings(vocabulary))) >= least
    rows = materialize(cut.withColumn("text", F.when(enough, F.col("text"))))
    order = token_order(rows, every_token)
    found = _verified(_candidates(rows, wanted, [t for t in order if t in set(vocabulary)], threshold)) if wanted else None

    hits = [F.col(f"p{i}") for i in range(len(base))]
    places = F.concat(*hits) if hits else F.array().cast("array<int>")
    base_labels = F.array_compact(F.array(*(F.when(F.size(h) > 0, F.lit(label)) for h, (_, label) in zip(hits, base)))) if hits else _strings([])
    if found is None:
        rows = rows.withColumn("own", _strings([])).withColumn("share", F.lit(0.0))
    else:
        labels = F.element_at(_strings([label for label, _ in named]), F.col("template") + 1)
        own = found.groupBy("rid").agg(F.collect_set(labels).alias("own"), F.max("share").alias("share"))
        rows = rows.join(own, "rid", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size(places) > 0, 1.0).otherwise(0.0))
    return rows.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("n_words").cast("long"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.coalesce("own", _strings([])))).alias("labels"),
        F.round(score, 6).alias("score"),
    )


def sql(base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the result on documents, by comparing every line and run of words with every template of which a text holds enough."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = lambda s: f"regexp_extract_all({s}, {quote(WORD)})"
    phrases, labels = [], []
    for phrase, label in base:
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k + 1}] = {quote(p)}" for k, p in enumerate(parts))
        phrases.append(f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: {test})")
        labels.append(label)
    tests, own = [], []
    fold = str.maketrans(UPPER, LOWER)
    for (label, ts), (_, text) in zip(template_tokens(templates), templates):
        need, length = max(1, math.ceil(threshold * len(ts) - 1e-9)), len(re.findall(WORD, text.translate(fold)))
        tokens = f"[{', '.join(map(quote, ts))}]"
        both = lambda block: f"len(list_intersect({block}, {tokens}))"
        by_line = f"list_max(list_transform(bs, lambda b: {both('b')}))"
        by_run = f"list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({tokens}, w[i])), lambda i: {both(f'w[i : i + {length - 1}]')}))"
        most = f"greatest({by_line}, {by_run})"
        tests.append(f"CASE WHEN {both('w')} < {need} THEN 0.0 WHEN {most} >= {need} THEN {most} / {float(len(ts))} ELSE 0.0 END")
        own.append(label)
    base_list = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN {quote(x)} END" for i, x in enumerate(labels))
    own_list = ", ".join(f"CASE WHEN t{i} > 0 THEN {quote(x)} END" for i, x in enumerate(own))
    joined = lambda s: f"array_to_string(list_sort(list_distinct(list_filter([{s}], lambda x: x IS NOT NULL))), ',')"
    every = "flatten([" + ", ".join(f"p{i}" for i in range(len(base))) + "])"
    return f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, {words("low")} AS w, list_transform(string_split(low, chr(10)), lambda x: {words("x")}) AS bs FROM l),
p AS (SELECT doc_id, len(w) AS n, {", ".join(f"{x} AS p{i}" for i, x in enumerate(phrases))}, {", ".join(f"{x} AS t{i}" for i, x in enumerate(tests))} FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
  {joined(base_list)} AS base_labels, {joined(base_list + ", " + own_list)} AS labels,
  round(CAST(greatest({", ".join(f"coalesce(t{i}, 0)" for i in range(len(own)))}, CASE WHEN len({every}) > 0 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS score
FROM p"""
