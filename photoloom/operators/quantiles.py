"""Exact quantiles of columns of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are brought to the driver at most.
FEW = 50_000


def exact_median(df: DataFrame, column: str, *, few: int = FEW, accuracy: int = 10_000) -> float | None:
    """The exact median (null and NaN left out; None of nothing).

    A mergeable sketch brackets the middle ranks, one pass counts what is below the bracket, and the bracket is narrowed until it
    holds at most ``few`` values (or one value only); no task and no driver ever holds more than a sketch or these."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = v.count()
    if not n:
        return None
    low, high, below, inside = None, None, 0, n
    first, last = (n - 1) // 2, n // 2
    part = v
    while inside > few:
        at = ((first + last) / 2 - below) / inside
        room = 3 / accuracy
        a, b = part.agg(F.percentile_approx("v", [max(0.0, at - room), min(1.0, at + room)], accuracy)).first()[0]
        new = part.where(F.col("v").between(a, b))
        under, within = part.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v").between(a, b), 1))).first()
        if a == b and below + under <= first and last < below + under + within:
            return a
        if not (below + under <= first and last < below + under + within) or within == inside:
            break
        part, below, inside = new, below + under, within
    if inside > few:
        # Values that repeat too often for a bracket: counts of the distinct ones, by running sums.
        counts = part.groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
        seen, found = below, {}
        for row in counts.toLocalIterator():
            for rank in (first, last):
                if seen <= rank < seen + row["n"]:
                    found[rank] = row["v"]
            seen += row["n"]
            if seen > last:
                break
        return (found[first] + found[last]) / 2
    values = sorted(r["v"] for r in part.collect())
    return (values[first - below] + values[last - below]) / 2
