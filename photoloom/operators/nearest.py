"""Nearest joins on one axis (time, exposure), and the rules that make matches unique.

A nearest join is a union of both sides, sorted once by the axis within each key: the last row of the other side before and
after is found by two windows that only look back (one over the descending order), so a partition is passed twice, whatever the
number of candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_on_axis(left: DataFrame, right: DataFrame, by: list[str], axis: str, right_id: str, *, direction: str = "both", period: float | None = None) -> DataFrame:
    """``left`` with ``near_<right_id>`` and ``near_<axis>`` of the nearest right row of equal ``by``; of two at equal distance the
    earlier one, of several at one place the one of the smallest id.  ``direction`` is both, backward or forward.

    With ``period``, a key's rows are sorted in periods of the axis, so that a hot key is spread; what is nearest in the periods
    before and after is carried over from one row for each period.  The result is the same."""
    cols = left.columns
    a = left.select(F.struct(*cols).alias("_l"), *(F.col(c).alias(f"_b_{c}") for c in by), F.col(axis).cast("double").alias("_t"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("_id"), F.lit(1).alias("_side"))
    b = right.where(F.col(axis).isNotNull()).groupBy(*(F.col(c).alias(f"_b_{c}") for c in by), F.col(axis).cast("double").alias("_t")).agg(F.min(right_id).alias("_id"))
    b = b.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), *(f"_b_{c}" for c in by), "_t", "_id", F.lit(0).alias("_side"))
    keys = [f"_b_{c}" for c in by]
    spot = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    both = a.unionByName(b)
    if period:
        both = both.withColumn("_p", F.floor(F.col("_t") / period))
        ends = both.groupBy(*keys, "_p").agg(F.min(spot).alias("_first"), F.max(spot).alias("_last"))
        periods = W.partitionBy(*keys).orderBy("_p")
        ends = ends.select(
            *(F.col(k).alias(f"_k{k}") for k in [*keys, "_p"]),
            F.last("_last", ignorenulls=True).over(periods.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
            F.last("_first", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"),
        )
        both = both.join(ends, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in [*keys, "_p"]]).drop(*(f"_k{k}" for k in [*keys, "_p"]))
        keys = [*keys, "_p"]
    up = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
    if direction in ("both", "backward"):
        before = F.last(spot, ignorenulls=True).over(up)
        both = both.withColumn("_before", F.coalesce(before, "_earlier") if period else before)
    if direction in ("both", "forward"):
        after = F.last(spot, ignorenulls=True).over(down)
        both = both.withColumn("_after", F.coalesce(after, "_later") if period else after)
    if direction == "both":
        nearer = F.coalesce(F.col("_after.t") - F.col("_t") < F.col("_t") - F.col("_before.t"), F.col("_before").isNull())
        near = F.when(nearer, F.col("_after")).otherwise(F.col("_before"))
    else:
        near = F.col("_before" if direction == "backward" else "_after")
    out = both.where(F.col("_side") == 1).withColumn("_near", F.when(F.col("_t").isNotNull(), near))
    return out.select("_l.*", F.col("_near.id").alias(f"near_{right_id}"), F.col("_near.t").alias(f"near_{axis}"))


def mutual_best(pairs: DataFrame, left: list[str], right: list[str], dist: str) -> DataFrame:
    """Pairs that are the nearest of their left row, and then, of those, the nearest of their right row. Exact ties are kept."""
    first = pairs.withColumn("_r", F.rank().over(W.partitionBy(*left).orderBy(dist))).where("_r = 1").drop("_r")
    return first.withColumn("_r", F.rank().over(W.partitionBy(*right).orderBy(dist))).where("_r = 1").drop("_r")


def unambiguous(pairs: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pairs whose left row has no other pair, and then, of those, whose right row has no other."""
    first = pairs.withColumn("_n", F.count("*").over(W.partitionBy(*left))).where("_n = 1").drop("_n")
    return first.withColumn("_n", F.count("*").over(W.partitionBy(*right))).where("_n = 1").drop("_n")
