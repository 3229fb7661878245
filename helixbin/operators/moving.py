"""Communities of graphs that no worker can hold: local moving, refinement and aggregation as joins and sums.

In a step every active vertex sums its links by community (a join and an aggregation) and picks the community of most gain under
the constant Potts model. Of the vertices that want to move, those of the highest draw among their moving neighbours do, so that no
two neighbours move at once; of those that touch one community, each must still gain after what the ones before it add to
or take from that community's size. So each step's changes together raise the quality, and steps end. Neighbours of
moved vertices and vertices that were held back are the next step's active ones.

A pass moves, refines each community from single vertices along its own links, and aggregates the refined parts, until nothing is
left to aggregate; passes repeat from the last result until the quality no longer grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbin.operators.ranking import ranked
from helixbin.sources.store import materialize

#: Gains below this do not count.
LEAST_GAIN = 1e-9


def quality(vertices: DataFrame, links: DataFrame, gamma: float) -> float:
    """Weight of links inside communities, less gamma times the pairs inside; of (node, size, label) and (u, v, w) in both directions."""
    of = vertices.select("node", "label")
    inside = links.join(of.toDF("u", "lu"), "u").join(of.toDF("v", "lv"), "v").where("lu = lv").agg(F.sum("w")).first()[0] or 0.0
    pairs = vertices.groupBy("label").agg((F.sum("size") * F.sum("size") / 2).alias("p")).agg(F.sum("p")).first()[0] or 0.0
    return inside / 2 - gamma * pairs


def moved(vertices: DataFrame, links: DataFrame, gamma: float, fresh: int) -> DataFrame:
    """(node, size, label) after local moving; labels from ``fresh`` on are free."""
    active, step = None, 0
    while True:
        if active is None:
            own = links
        else:
            own = links.join(active.withColumnRenamed("node", "u"), "u", "left_semi")
        sizes = vertices.groupBy("label").agg(F.sum("size").alias("total"))
        linked = own.join(vertices.select(F.col("node").alias("v"), "label"), "v").groupBy("u", "label").agg(F.sum("w").alias("k"))
        here = vertices.join(sizes, "label").select(F.col("node").alias("u"), "size", F.col("label").alias("own"), (F.col("total") - F.col("size")).alias("others"))
        gains = linked.join(sizes, "label").join(here, "u")
        gain = F.col("k") - gamma * F.col("size") * F.col("total")
        other = F.when(F.col("label") != F.col("own"), F.struct(gain.alias("gain"), (-F.col("label")).alias("minus")))
        best = gains.groupBy("u", "own", "size", "others").agg(F.max(other).alias("best"), F.max(F.when(F.col("label") == F.col("own"), F.col("k"))).alias("k"))
        stay = F.coalesce("k", F.lit(0.0)) - gamma * F.col("size") * F.col("others")
        alone = F.struct(F.lit(0.0).alias("gain"), (-(F.lit(fresh) + F.col("u"))).alias("minus"))
        best = best.withColumn("best", F.when(F.col("best").isNull() | (F.col("best.gain") < 0), alone).otherwise(F.col("best")))
        wish = best.select("u", "own", "size", (-F.col("best.minus")).alias("to"), (F.col("best.gain") - stay).alias("rise"), F.xxhash64("u", F.lit(step)).alias("draw"))
        wish = materialize(wish.where(F.col("rise") > LEAST_GAIN))
        if wish.isEmpty():
            return vertices
        near = links.join(wish.select("u", "draw"), "u").join(wish.select(F.col("u").alias("v"), F.col("draw").alias("d2")), "v")
        beaten = near.where((F.col("d2") > F.col("draw")) | (F.col("d2") == F.col("draw")) & (F.col("v") > F.col("u"))).select("u").distinct()
        free = wish.join(beaten, "u", "left_anti")
        before = lambda c: F.coalesce(F.sum("size").over(Window.partitionBy(c).orderBy(F.desc("rise"), "u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        free = free.withColumns({"joined": before("to"), "left": before("own")})
        goes = materialize(free.where(F.col("rise") - gamma * F.col("size") * (F.col("joined") + F.col("left")) > LEAST_GAIN).select("u", "to"))
        stirred = links.join(goes.select("u"), "u", "left_semi").select(F.col("v").alias("node")).union(wish.join(goes, "u", "left_anti").select("u"))
        active = materialize(stirred.distinct())
        vertices = materialize(vertices.join(goes.withColumnRenamed("u", "node"), "node", "left").select("node", "size", F.coalesce("to", "label").alias("label")))
        names = vertices.agg(F.max("label")).first()[0]
        fresh, step = max(fresh, names + 1), step + 1


def _pass(vertices: DataFrame, links: DataFrame, gamma: float, fresh: int) -> DataFrame:
    """(node, label) of the vertices after one pass from their labels."""
    member = vertices.select("node", F.col("node").alias("part"))
    while True:
        vertices = moved(vertices, links, gamma, fresh)
        label = vertices.select("node", "label")
        inside = materialize(links.join(label.toDF("u", "lu"), "u").join(label.toDF("v", "lv"), "v").where("lu = lv").select("u", "v", "w"))
        single = materialize(vertices.select("node", "size", F.col("node").alias("label")))
        fine = moved(single, inside, gamma, fresh).select("node", F.col("label").alias("fine"))
        # a part is named by its first vertex
        parts = materialize(fine.join(fine.groupBy("fine").agg(F.min("node").alias("part")), "fine").select("node", "part"))
        n, k = parts.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
        if k == n:
            return member.join(label.withColumnRenamed("node", "part"), "part").select("node", "label")
        member = materialize(member.join(parts.toDF("part", "next"), "part").select("node", F.col("next").alias("part")))
        ends = links.join(parts.toDF("u", "pu"), "u").join(parts.toDF("v", "pv"), "v").where("pu <> pv")
        links = materialize(ends.groupBy("pu", "pv").agg(F.sum("w").alias("w")).toDF("u", "v", "w"))
        vertices = materialize(vertices.join(parts, "node").groupBy("part").agg(F.sum("size").alias("size"), F.min("label").alias("label")).withColumnRenamed("part", "node"))


def communities(vertices: DataFrame, edges: DataFrame, gamma: float) -> DataFrame:
    """(contig, bin): communities of (contig) and (src, dst), each edge counted once, with the least contig as bin."""
    names = materialize(ranked(vertices.select("contig").distinct(), "contig", "node"))
    flat = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    numbered = flat.join(names.toDF("src", "u"), "src").join(names.toDF("dst", "v"), "dst").select("u", "v")
    links = materialize(numbered.union(numbered.select("v", "u")).withColumn("w", F.lit(1.0)))
    n = names.count()
    labels = names.select("node", F.lit(1.0).alias("size"), F.col("node").alias("label"))
    best, found = None, None
    while True:
        labels = materialize(labels)
        out = materialize(_pass(labels, links, gamma, n))
        # labels start at 0 again: each is its first vertex
        first = out.groupBy("label").agg(F.min("node").alias("first"))
        labels = out.join(first, "label").select("node", F.lit(1.0).alias("size"), F.col("first").alias("label"))
        reached = quality(labels, links, gamma)
        if best is not None and reached <= best + LEAST_GAIN:
            break
        best, found = reached, labels
    bins = found.join(names, "node").select("contig", "label")
    return bins.join(bins.groupBy("label").agg(F.min("contig").alias("bin")), "label").select("contig", "bin")
