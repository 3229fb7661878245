"""Mixing sources to target weights under a time-varying curriculum; DataFrame functions only.

Each source has a weight schedule over training time 0 to 1. Its integral is the source's weight; weights
share the token budget, no source repeats more than MAX_REPEATS times, and the excess is shared again.
Cumulative demand of a source at time t is its target times the normalised integral of its schedule up to t.
The documents of a source stand in a fixed pseudo-random order; a copy that starts at cumulative token c is
trained at the time when demand reaches c. Sorting by that time gives the training order.

Running totals never put a source into one task: the order is by hash, the hash's leading digits are a bucket,
and a document's total is that of the buckets before its own (a bounded number) plus that inside its bucket.

Defined results: null text has size 0 and is never taken; null source is a source, last in order; rows are
counted singly, so repeated rows each have their share (order among equal ids and sizes does not matter as
they are equal); an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weight and schedule of the sources in code point order, repeating: knots (time, factor), linear between them.
#: Each schedule's integral is 1, so that it bends the weight over time without changing it.
CURRICULUM = ((5.0, ((0.0, 1.4), (1.0, 0.6))), (2.0, ((0.0, 0.8), (0.5, 1.2), (1.0, 0.8))), (1.0, ((0.0, 0.6), (1.0, 1.4))))
#: Most copies of a document, and so most of a source's size that its target can be.
MAX_REPEATS = 3
#: Documents that one bucket holds on average, and most buckets of a source; neither changes any result.
BUCKET_ROWS, MAX_BUCKETS = 2000, 65536


def integral(knots: tuple[tuple[float, float], ...]) -> list[float]:
    """Integral of the schedule from 0 to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a share of the schedule's integral is reached: the inverse of its piecewise quadratic integral."""
    at = integral(knots)
    y = share * at[-1]
    out = F.lit(knots[-1][0])
    for i in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        rest = F.greatest(y - at[i], F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        out = F.when(y <= at[i + 1], t0 + 2 * rest / F.greatest(w0 + root, F.lit(1e-12))).otherwise(out)
    return out


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rank from 0 of the rows by a distinct key, without gathering them in one task."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return rows.join(sizes, "_part").withColumn(name, F.col("_before") + local - 1).drop("_part", "_before")


def targets(sources: DataFrame, curriculum=CURRICULUM) -> DataFrame:
    """(key, source_size, kind, target) from (key, source_size); kind is the place of a source's schedule in the curriculum."""
    kinds = len(curriculum)
    rows = ranked(sources, "key", "rank").withColumn("kind", (F.col("rank") % kinds).cast("int")).drop("rank")
    weight = F.element_at(F.array(*(F.lit(w * integral(k)[-1]) for w, k in curriculum)), F.col("kind") + 1)
    rows = materialize(rows.withColumn("weight", weight))
    cap = MAX_REPEATS * F.col("source_size")
    level = 0.0
    while True:  # each pass finds more sources at their cap, or is the last
        full = F.col("weight") * level > cap
        size, capped, open_weight = rows.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        found = ((size or 0) - (capped or 0)) / open_weight if open_weight else level
        if found <= level:
            break
        level = found
    return rows.select("key", "source_size", "kind", F.least(F.col("weight") * level, cap.cast("double")).alias("target"))


def planned(docs: DataFrame, curriculum=CURRICULUM) -> DataFrame:
    """One row per document of docs (doc_id, text, source): doc_id, size, source_size, target, taken, and copies,
    an array of (position, words) of the copies that the mix takes. Only the last copy of a source can be cut short."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">"))  # null after all others
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialize(docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), order.alias("h")))
    total = rows.count()
    digits = 0
    while 16**digits * BUCKET_ROWS < total and 16 ** (digits + 1) <= MAX_BUCKETS:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    buckets = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_source = targets(buckets.groupBy("key").agg(F.sum("n").alias("source_size")), curriculum)
    starts = buckets.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(by_source, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, ["key", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    demand = F.floor(F.col("target") + 0.5)
    copies = []
    for e in range(MAX_REPEATS):
        start = F.col("start") + e * F.col("source_size")
        words = F.least(F.greatest(demand - start, F.lit(0)), F.col("size"))
        share = start / F.greatest(F.col("target"), F.lit(1e-9))
        position = F.lit(None).cast("double")
        for k, (_, knots) in enumerate(curriculum):
            position = F.when(F.col("kind") == k, time_of(share, knots)).otherwise(position)
        copies.append(F.when(words > 0, F.struct(F.round(position, 9).alias("position"), words.alias("words"))))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.withColumn("copies", F.array_compact(F.array(*copies))).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(plan: DataFrame) -> DataFrame:
    """A row per copy, range-sorted by training position: the columns of the plan, with position and words for copies."""
    rest = [c for c in plan.columns if c != "copies"]
    return plan.select(*rest, F.explode("copies").alias("copy")).select(*rest, "copy.*").orderBy("position", "doc_id")


def sql(curriculum=CURRICULUM) -> str:
    """DuckDB SQL for op2's rows: the caps are filled in the order in which they bind."""
    at = lambda kinds: " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(kinds))
    times = []
    for _, knots in curriculum:
        sums, cases = integral(knots), ""
        for i in range(len(knots) - 1):
            (t0, w0), (t1, w1) = knots[i], knots[i + 1]
            rest, slope = f"greatest(y * {sums[-1]!r} - {sums[i]!r}, 0.0)", (w1 - w0) / (t1 - t0)
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0))"
            cases += f" WHEN y * {sums[-1]!r} <= {sums[i + 1]!r} THEN {t0!r} + 2 * {rest} / greatest({w0!r} + {root}, 1e-12)"
        times.append(f"CASE{cases} ELSE {knots[-1][0]!r} END")
    taken = " + ".join(f"greatest(0, least(size, demand - (start + {e} * source_size)))" for e in range(MAX_REPEATS))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
k AS (SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(curriculum)} AS kind FROM s),
w AS (SELECT source, n, kind, CASE kind {at(repr(float(w * integral(c)[-1])) + "::DOUBLE" for w, c in curriculum)} END AS weight FROM k),
c AS (SELECT *, {MAX_REPEATS} * n AS cap, {MAX_REPEATS} * n / weight AS r, coalesce(sum({MAX_REPEATS} * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM w WINDOW o AS (ORDER BY {MAX_REPEATS} * n / weight, source)),
l AS (SELECT arg_min(level, r) AS level FROM (SELECT r, (CAST((SELECT sum(n) FROM s) AS DOUBLE) - CAST(full_ AS DOUBLE)) / open_ AS level FROM c) WHERE r >= level),
t AS (SELECT source, n AS source_size, kind, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM c, l),
p AS (SELECT doc_id, size, source_size, target, kind, floor(target + 0.5) AS demand, sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, start / greatest(target, 1e-9) AS y FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST({taken} AS BIGINT) AS taken,
  CASE WHEN least(size, demand - start) > 0 THEN round(CASE kind {at(times)} END, 9) END AS first_position FROM y"""
