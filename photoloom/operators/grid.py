"""Irregular readings onto a regular grid (problem 3).

``regular_grid`` takes readings at uneven times and gives, for each series, one row for each cell of a regular grid between its
first and its last reading.  The readings are cumulative counters (or gauges, of which the running number of readings is the
counter): consecutive readings are differenced, a fall of the counter is a reset and counts from zero, and the increment of the
interval between two readings is spread over the cells it overlaps, in proportion to the overlap.  A cell that only such
intervals reach, but no reading, is uncovered: it is marked, and its value is interpolated between the readings around it.

Everything is window and aggregate expressions over one shuffle on the series' keys; a period (a night) is part of these keys, so
that a source with a third of all readings is spread over its nights.

Defined results
---------------
* null or NaN values and null times are no readings; a series with one reading has one cell.
* several readings in a cell are one covered cell with their mean; repeated rows add nothing to a counter.
* null keys form series of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.operators.spikes import image_times

#: Cells of ten minutes in a day.
TEN_MINUTES = 144


def regular_grid(readings: DataFrame, keys: list[str], time: str, value: str, *, cells_per_day: int = TEN_MINUTES, counter: str | None = None) -> DataFrame:
    """``keys``, night, slot, n_readings, mean_value, filled_value, increment, missing.

    ``time`` is in days; ``slot`` = floor(time x cells_per_day), ``night`` = floor(time).  With ``counter``, that column is the
    cumulative counter whose increments are spread; without, every reading counts one.
    """
    per = F.lit(cells_per_day)
    t, v = F.col("_t"), F.col("_v")
    rows = readings.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(time).isNotNull()).select(
        *keys, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"), (F.col(counter).cast("double") if counter else F.lit(None).cast("double")).alias("_c"), F.floor(time).cast("long").alias("night")
    )
    series = W.partitionBy(*keys, "night").orderBy("_t", "_v", "_c")
    before: dict[str, Column] = {"_t0": F.lag("_t").over(series), "_v0": F.lag("_v").over(series), "_c0": F.lag("_c").over(series)}
    d = rows.withColumns(before)
    rise = F.when(F.col("_c") >= F.col("_c0"), F.col("_c") - F.col("_c0")).otherwise(F.col("_c")) if counter else F.lit(1.0)
    slot = F.floor(t * per).cast("long")
    d = d.withColumns({"_rise": F.when(F.col("_t0").isNotNull(), rise), "_slot": slot, "_slot0": F.coalesce(F.floor(F.col("_t0") * per).cast("long"), slot)})
    d = d.withColumn("slot", F.explode(F.sequence("_slot0", "_slot")))
    low, high = F.greatest(F.col("_t0"), F.col("slot") / per), F.least(t, (F.col("slot") + 1) / per)
    span = t - F.col("_t0")
    share = F.when(span > 0, F.greatest(high - low, F.lit(0.0)) / span).otherwise(F.when(F.col("slot") == F.col("_slot"), 1.0).otherwise(0.0))
    here = F.col("slot") == F.col("_slot")
    middle = (F.col("slot") + 0.5) / per
    between = F.when((F.col("slot") > F.col("_slot0")) & ~here, F.col("_v0") + (v - F.col("_v0")) * (middle - F.col("_t0")) / span)
    cells = d.groupBy(*keys, "night", "slot").agg(
        F.count(F.when(here, 1)).alias("n_readings"),
        F.avg(F.when(here, v)).alias("mean_value"),
        F.max(between).alias("_between"),
        F.sum(F.col("_rise") * share).alias("increment"),
    )
    return cells.select(*keys, "night", "slot", "n_readings", "mean_value", F.coalesce("mean_value", "_between").alias("filled_value"), "increment", (F.col("n_readings") == 0).alias("missing"))


def light_curve_grid(photometry: DataFrame, frames: DataFrame, value: str = "mag_cali_trans") -> DataFrame:
    """The regular series of each source and filter, one for each night."""
    rows = photometry.where(F.col("object_id").isNotNull() & F.col(value).isNotNull()).select("image_id", "object_id", "filter_name", value)
    timed = rows.join(image_times(frames), "image_id").drop("image_id")
    return regular_grid(timed, ["object_id", "filter_name"], "jd", value)


def gaps_found(photometry: DataFrame, frames: DataFrame) -> DataFrame:
    """object_id, filter_name, slot of every cell without a reading between the first and the last of its night."""
    return light_curve_grid(photometry, frames).where("missing").select("object_id", "filter_name", "slot")


def exposure_odometer_grid(frames: DataFrame, rolls_at: float = 1000.0) -> DataFrame:
    """Exposure seconds of each object on the regular grid, from an odometer that adds up the seconds of the night's frames and
    starts again whenever it passes ``rolls_at``: a cumulative counter with resets, read at uneven times."""
    f = frames.where("image_id IS NOT NULL AND object_name IS NOT NULL AND exptime IS NOT NULL").groupBy("image_id").agg(F.min("object_name").alias("object_name"), F.min("exptime").alias("exptime"))
    f = f.join(image_times(frames), "image_id").where("jd IS NOT NULL")
    so_far = F.sum("exptime").over(W.partitionBy("object_name", F.floor("jd")).orderBy("jd", "image_id").rowsBetween(W.unboundedPreceding, 0))
    f = f.withColumn("odometer", F.pmod(so_far, F.lit(rolls_at)))
    return regular_grid(f, ["object_name"], "jd", "exptime", counter="odometer")
