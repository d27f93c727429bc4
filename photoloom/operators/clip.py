"""Iterative sigma clipping: the aggregate that the calibration rests on.

Readings outside ``centre +- k * spread`` of the readings still in are dropped, again and again; bounds are inclusive, the spread
is the population standard deviation (or the scaled median absolute deviation).  What is left of a *sorted* group is always one
slice of it, so a group is sorted once, after one shuffle, and its slice shrinks round by round, many groups at a time in NumPy: no
round of aggregates and joins for each iteration.  Groups must be bounded by nature (an image, a night of a source).  For groups that grow with the data,
``sigma_clip_counted`` clips the counts of their distinct values (printed values repeat) with exact results, and
``sigma_clip_large`` does the rounds with mergeable sketches.

Null and NaN values are left out; a group of nothing else has null statistics and n = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.482602218505602


def array_median(a: Column) -> Column:
    """Median of a sorted array (null if empty)."""
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_std(a: Column, mean: Column) -> Column:
    """Population standard deviation."""
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a)))


def clip_slices(v: np.ndarray, begin: np.ndarray, end: np.ndarray, k: float, iterations: int, centre: str, spread: str, counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Clip the sorted slices ``begin`` to ``end`` of ``v`` (each value ``counts`` times), all of them round by round: n, mean,
    median, std of what is left, its least and most, the last bounds, and the standard deviation before."""
    group = np.repeat(np.arange(len(begin)), end - begin)
    place = np.arange(len(v))
    w = np.ones(len(v), np.int64) if counts is None else counts.astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(w)])

    def total(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = (place >= a[group]) & (place < b[group])
        return np.bincount(group, weights=np.where(inside, x * w, 0.0), minlength=len(begin))

    def middle(x: np.ndarray, a: np.ndarray, n: np.ndarray, upto: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.full(len(a), np.nan)
        low, high = (np.minimum(np.searchsorted(upto, upto[a] + rank, side="right") - 1, len(x) - 1) for rank in (np.maximum(n - 1, 0) // 2, n // 2))
        return (x[low] + x[high]) / 2

    def moments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = upto[b] - upto[a]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total(v, a, b) / n
            return n, mean, np.sqrt(total((v - mean[group]) ** 2, a, b) / n)

    a, b = begin.copy(), end.copy()
    before = moments(a, b)[2]
    low, high = np.full(len(a), np.nan), np.full(len(a), np.nan)
    for _ in range(iterations):
        n, mean, std = moments(a, b)
        at = middle(v, a, n, upto) if centre == "median" else mean
        if spread == "mad":
            # Deviations of what is left, sorted within the slices; the rest goes behind them.
            off = np.where((place >= a[group]) & (place < b[group]), np.abs(v - at[group]), np.inf)
            order = np.lexsort((off, group))
            std = MAD_TO_SIGMA * middle(off[order], begin, n, np.concatenate([[0], np.cumsum(w[order])]))
        # What is left is empty: the bounds stay as they were.
        some = b > a
        low, high = np.where(some, at - k * std, low), np.where(some, at + k * std, high)
        inside = (place >= a[group]) & (place < b[group])
        under = np.bincount(group[inside & (v < low[group])], minlength=len(a))
        over = np.bincount(group[inside & (v > high[group])], minlength=len(a))
        a, b = a + under, b - over
        if not (under.any() or over.any()):
            break
    n, mean, std = moments(a, b)
    ends = [v[np.clip(x, 0, len(v) - 1)] if len(v) else np.full(len(a), np.nan) for x in (a, b - 1)]
    return {"n": n, "mean": mean, "median": middle(v, a, n, upto), "std": std, "least": ends[0], "most": ends[1], "low": low, "high": high, "std_before": before}


#: Columns that clipping a group gives.
CLIPPED = "n long, mean double, median double, std double, least double, most double, low double, high double, std_before double"


def _clip_lists(g: DataFrame, keys: list[str], k: float, iterations: int, centre: str, spread: str) -> DataFrame:
    """Clip the lists ``_a`` of values, or of (v, n), of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            values, counts = (flat, None) if not pa.types.is_struct(flat.type) else (flat.field("v"), flat.field("n").to_numpy(zero_copy_only=False))
            values = values.to_numpy(zero_copy_only=False)
            order = np.lexsort((values, np.repeat(np.arange(len(length)), length)))
            end = np.cumsum(length)
            got = clip_slices(values[order], end - length, end, k, iterations, centre, spread, None if counts is None else counts[order])
            none = got["n"] == 0
            columns = [pa.array(x, mask=none | np.isnan(x) if name != "n" else None) for name, x in got.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [*keys, *got])

    kinds = dict(g.dtypes)
    return g.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", {CLIPPED}")


def clip_groups(df: DataFrame, keys: list[str], value: str | Column, k: float, *, iterations: int = 5, centre: str = "median", spread: str = "std") -> DataFrame:
    """``keys`` and ``CLIPPED`` of each group. Groups are gathered by one shuffle and clipped many at a time in Arrow batches."""
    v = F.col(value) if isinstance(value, str) else value
    g = df.select(*keys, v.cast("double").alias("_v")).groupBy(*keys).agg(F.collect_list(F.when(~F.isnan("_v"), F.col("_v"))).alias("_a"))
    return _clip_lists(g, keys, k, iterations, centre, spread)


def sigma_clip_stats(df: DataFrame, keys: list[str], value: str | Column, k: float, **how) -> DataFrame:
    """``keys``, n, mean, median, std of what sigma clipping leaves."""
    return clip_groups(df, keys, value, k, **how).select(*keys, "n", "mean", "median", "std")


def sigma_clip_flags(df: DataFrame, keys: list[str], value: str, k: float, *, tolerance: float | None = None, **how) -> DataFrame:
    """``df`` with ``clipped``: whether a reading is outside the last bounds of its group (null for a null reading). With
    ``tolerance``, nothing is clipped in a group whose standard deviation does not exceed it."""
    bounds = clip_groups(df, keys, value, k, **how).select(*(F.col(c).alias(f"_k_{c}") for c in keys), "low", "high", "std_before")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    joined = df.join(bounds, on, "left")
    outside = ~F.col(value).between(F.col("low"), F.col("high"))
    if tolerance is not None:
        outside = (F.col("std_before") > tolerance) & outside
    return joined.withColumn("clipped", outside).drop("low", "high", "std_before", *(f"_k_{c}" for c in keys))


def sigma_clip_counted(df: DataFrame, keys: list[str], value: str | Column, k: float, *, iterations: int = 5, centre: str = "median", extremes: bool = False) -> DataFrame:
    """As ``sigma_clip_stats`` (with ``extremes`` also least and most) without the groups of n = 0, for groups of many readings of few distinct values: equal readings are
    counted before the group is brought together, so that it is as long as its number of distinct values."""
    v = F.col(value) if isinstance(value, str) else value
    h = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    g = h.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n"))).alias("_a"))
    c = _clip_lists(g, keys, k, iterations, centre, "std").where("n > 0")
    return c.select(*keys, "n", "mean", "median", "std", *(["least", "most"] if extremes else []))


def sigma_clip_large(df: DataFrame, keys: list[str], value: str, k: float, *, iterations: int = 5, accuracy: int = 100_000) -> DataFrame:
    """As ``sigma_clip_stats`` for groups of any size: each round is one aggregate with partial sums and a quantile sketch of
    bounded size (rank error 1 / accuracy), joined back by key."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    stats = [F.count("*").alias("n"), F.avg("_v").alias("mean"), F.percentile_approx("_v", 0.5, accuracy).alias("median"), F.stddev_pop("_v").alias("std")]
    left = rows
    for _ in range(iterations):
        s = left.groupBy(*keys).agg(*stats)
        b = s.select(*(F.col(c).alias(f"_k_{c}") for c in keys), (F.col("median") - k * F.col("std")).alias("_low"), (F.col("median") + k * F.col("std")).alias("_high"))
        on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
        left = left.join(b, on).where(F.col("_v").between(F.col("_low"), F.col("_high"))).select(*keys, "_v")
    return left.groupBy(*keys).agg(*stats)
