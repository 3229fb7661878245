"""Training pairs: positive and negative fragment pairs, drawn by an arithmetic hash so that reruns and oracles agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbin.functions.sequence import averaged, optimal_distance
from helixbin.sources.store import materialize

#: Fixed values of the generator behind draws.
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483648


def draw(x: Column) -> Column:
    """A draw in [0, 2**31) from an integer."""
    return (x.cast("long") % MODULUS * MULTIPLIER + INCREMENT) % MODULUS


def positive_pairs(frags: DataFrame, fppc: int, seed: int = 1) -> DataFrame:
    """(contig, i, j) from (contig, n): the first fppc pairs, in order, of fragments at the optimal distance; where a contig
    has fewer, fppc drawn pairs instead, which may be equal."""
    # narrow rows; else each of the conditions below would count the fragments again, and so read the sequences again
    frags = materialize(frags.select("contig", "n"))
    d = F.greatest(optimal_distance(F.col("n"), fppc), F.lit(1))
    rows = frags.where("n > 0").withColumn("d", d)
    some = rows.where("n > d").select("contig", "n", "d", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("d") - 1)).alias("i"))
    # pairs of earlier i: the first fppc are found without listing the others
    before = F.col("i") * (F.col("n") - F.col("d")).cast("long") - F.col("i") * (F.col("i") - 1) / 2
    some = some.where(before < fppc).select("contig", "i", F.explode(F.sequence(F.col("i") + F.col("d"), F.col("n") - 1)).alias("j"))
    rank = F.row_number().over(Window.partitionBy("contig").orderBy("i", "j"))
    found = some.withColumn("r", rank).where(F.col("r") <= fppc)
    counted = found.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("contig")))
    whole = counted.where(F.col("m") == fppc).select("contig", "i", "j")
    few = rows.withColumn("total", (F.col("n") - F.col("d")) * (F.col("n") - F.col("d") + 1) / 2).where((F.col("n") <= F.col("d")) | (F.col("total") < fppc))
    drawn = few.select("contig", "n", F.explode(F.sequence(F.lit(0), F.lit(fppc - 1))).alias("q"))
    pick = lambda side: (draw(F.pmod("contig", F.lit(MODULUS)) * 7919 + F.col("q") * 2 + side + seed) % F.col("n")).cast("int")
    return whole.unionByName(drawn.select("contig", pick(0).alias("i"), pick(1).alias("j")))


def some_of(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n of the pairs (contig, i, j), or all if there are fewer: the first in a fixed pseudo-random order, so that reruns agree."""
    return rows.orderBy(F.xxhash64("contig", "i", "j", F.lit(seed)), "contig", "i", "j").limit(n)


def negative_pairs(frags: DataFrame, n_pairs: int, seed: int = 1) -> DataFrame:
    """(pair, a, i, b, j): draws of two different contigs and a fragment of each, from (contig, n), uniform over contigs.

    Contigs are numbered by rank; draws look their numbers up by equi-joins. Draws of equal contigs move to the next one.
    """
    from helixbin.operators.ranking import ranked

    named = ranked(materialize(frags.select("contig", "n").where("n > 0")), "contig", "rank")
    total = named.count()
    if total < 2:
        raise RuntimeError("negative pairs need two contigs")
    spark = frags.sparkSession
    draws = spark.range(n_pairs).select(F.col("id").alias("pair"), (draw(F.col("id") * 4 + seed) % total).alias("ra"), (draw(F.col("id") * 4 + seed + 1) % total).alias("rb"))
    draws = draws.withColumn("rb", F.when(F.col("ra") == F.col("rb"), (F.col("rb") + 1) % total).otherwise(F.col("rb")))
    a, b = named.select(F.col("rank").alias("ra"), F.col("contig").alias("a"), F.col("n").alias("na")), named.select(F.col("rank").alias("rb"), F.col("contig").alias("b"), F.col("n").alias("nb"))
    out = draws.join(a, "ra").join(b, "rb")
    return out.select("pair", "a", (draw(F.col("pair") * 4 + seed + 2) % F.col("na")).cast("int").alias("i"), "b", (draw(F.col("pair") * 4 + seed + 3) % F.col("nb")).cast("int").alias("j"))


def split_test(contigs: DataFrame, ratio: float, seed: int = 1) -> DataFrame:
    """(contig, test): a share of the contigs, at least 2, by the rank of their draw; without replacement."""
    from helixbin.operators.ranking import ranked

    rows = contigs.select("contig", F.struct(draw(F.pmod("contig", F.lit(MODULUS)) * 31 + seed), "contig").alias("h"))
    total = rows.count()
    return ranked(rows, "h", "r").select("contig", (F.col("r") < max(2, int(ratio * total))).alias("test"))


def fragment_coverage(fragments: DataFrame, coverage: DataFrame, width: int, step: int) -> DataFrame:
    """(contig, sample, start, means) for the distinct fragments (contig, start, end) over coverage (contig, sample, depth ARRAY)."""
    missing = fragments.select("contig").distinct().join(coverage.select("contig").distinct(), "contig", "left_anti")
    if missing.limit(1).count():
        raise KeyError("a pair names a contig without coverage")
    rows = fragments.select("contig", "start", "end").distinct().join(coverage, "contig")
    part = F.slice("depth", F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select("contig", "sample", "start", averaged(F.transform(part, lambda x: x.cast("double")), width, step).alias("means"))
