"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbin.sources.store import materialize


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rank from 0 of the rows by a distinct key: ranges by key are counted, then ranked inside."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + local - 1).drop("_part", "_before")
