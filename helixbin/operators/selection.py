"""Exact percentiles of a column of any size, without gathering it in one buffer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbin.sources.store import materialize

#: Values that the last step sorts on the driver; it changes no result.
GATHERED = 10_000


def percentile(rows: DataFrame, column: str, q: float, gathered: int = GATHERED) -> float | None:
    """The q-quantile, interpolated between the two ranks around q * (n - 1); nulls do not count, no rows give null.

    A sketch brackets the ranks, a count says how many values lie below and inside, and the bracket is narrowed until its values
    are few or all equal. Where a sketch does not narrow it, its middle does."""
    values = materialize(rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull()))
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = q * (n - 1)
    first, second = math.floor(place), min(math.floor(place) + 1, n - 1)
    below, inside = 0, n  # values under lo, and from lo to hi
    inner = F.col("v").between

    def counted(a: float, b: float) -> tuple[int, int]:
        return values.agg(F.count_if(F.col("v") < a), F.count_if(inner(a, b))).first()

    while inside > gathered and lo < hi:
        share = (first - below) / inside
        sketch = values.where(inner(lo, hi)).agg(F.percentile_approx("v", [max(0.0, share - 0.002), min(1.0, share + 0.002)], 10_000)).first()[0]
        for a, b in ((sketch[0], sketch[1]), (lo, (lo + hi) / 2), (math.nextafter((lo + hi) / 2, math.inf), hi)):
            if (a, b) == (lo, hi) or a > b:
                continue
            under, within = counted(a, b)
            if under <= first and second < under + within:
                lo, hi, below, inside = a, b, under, within
                break
        else:  # the two ranks lie on either side of the middle
            middle = (lo + hi) / 2
            low = values.where(inner(lo, middle)).agg(F.max("v")).first()[0]
            high = values.where((F.col("v") > middle) & (F.col("v") <= hi)).agg(F.min("v")).first()[0]
            return low + (high - low) * (place - first)
    if lo == hi:
        return lo
    found = sorted(r["v"] for r in values.where(inner(lo, hi)).collect())
    low, high = found[first - below], found[second - below]
    return low + (high - low) * (place - first)
