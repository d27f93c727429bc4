"""Joins by distance, on the sky and in the pixel plane.

Both are equi-joins on grid cells: one side (the smaller) is put into its own cell and the neighbouring ones, the exact distance
decides afterwards.  The number of candidate rows grows with the pairs that are really near, and no side is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance of two positions in degrees, as arc seconds (haversine: exact for small angles)."""
    h = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (180 * 3600 / math.pi)


def _zone_cells(zone: Column, height: float) -> Column:
    """How many cells a declination zone has around the sky: each at least ``height`` wide where the zone is narrowest."""
    edge = F.least(F.greatest(F.abs(zone * height), F.abs((zone + 1) * height)), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(edge)) * (360 / height)), F.lit(1)).cast("long")


def sky_pairs(left: DataFrame, right: DataFrame, radius_arcsec: float, *, left_pos: tuple[str, str] = ("ra_deg", "dec_deg"), right_pos: tuple[str, str] = ("ra_deg", "dec_deg"), spread_by: str | None = None, ways: int = 8) -> DataFrame:
    """All pairs of rows within ``radius_arcsec``: ``l`` (struct of the left row), ``r`` (struct of the right row), ``sep_arcsec``.

    Rows with a null position pair with nothing; right ascension wraps at 360 degrees; zones meet at the poles. The right side is
    the one that is copied into neighbouring cells, so it should be the smaller one.  Where many left rows may share a spot (a star
    in all its images), ``spread_by`` names a left column by which a cell is split in ``ways``; the right side is copied into each.
    """
    height = max(radius_arcsec / 3600 * 1.0001, 1e-7)

    def placed(df: DataFrame, name: str, pos: tuple[str, str]) -> DataFrame:
        s = df.select(F.struct(*df.columns).alias(name), F.pmod(F.col(pos[0]), F.lit(360.0)).alias(f"_{name}ra"), F.col(pos[1]).alias(f"_{name}dec"))
        return s.where(F.col(f"_{name}ra").isNotNull() & F.col(f"_{name}dec").isNotNull()).withColumn("_zone", F.floor(F.col(f"_{name}dec") / height).cast("long"))

    cell = lambda ra: F.least(F.floor(ra / 360 * F.col("_n")).cast("long"), F.col("_n") - 1)
    a = placed(left, "l", left_pos).withColumn("_n", _zone_cells(F.col("_zone"), height)).withColumn("_cell", cell(F.col("_lra"))).drop("_n")
    b = placed(right, "r", right_pos).withColumn("_zone", F.explode(F.sequence(F.col("_zone") - 1, F.col("_zone") + 1))).withColumn("_n", _zone_cells(F.col("_zone"), height))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.col("_own") + k, F.col("_n"))))
    b = b.withColumn("_own", cell(F.col("_rra"))).withColumn("_cell", F.explode(around)).drop("_n", "_own")
    on = ["_zone", "_cell"]
    if spread_by:
        a = a.withColumn("_way", F.pmod(F.xxhash64(f"l.{spread_by}"), F.lit(ways)).cast("int"))
        b = b.withColumn("_way", F.explode(F.array(*(F.lit(k) for k in range(ways)))))
        on.append("_way")
    pairs = a.join(b, on).withColumn("sep_arcsec", separation_arcsec(F.col("_lra"), F.col("_ldec"), F.col("_rra"), F.col("_rdec")))
    return pairs.where(F.col("sep_arcsec") <= radius_arcsec).select("l", "r", "sep_arcsec")


def pixel_pairs(left: DataFrame, right: DataFrame, radius: float, *, by: list[str] | None = None, left_pos: tuple[str, str] = ("x", "y"), right_pos: tuple[str, str] = ("x", "y")) -> DataFrame:
    """All pairs within ``radius`` pixels (of equal ``by`` columns): ``l``, ``r``, ``dist``."""
    by = by or []
    # Cells of two radii: a row on the right reaches into two of them along each axis, so it is copied four times, not nine.
    size = 2 * float(radius) * 1.0001

    def placed(df: DataFrame, name: str, pos: tuple[str, str]) -> DataFrame:
        s = df.where(F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull())
        return s.select(F.struct(*df.columns).alias(name), F.col(pos[0]).alias(f"_{name}x"), F.col(pos[1]).alias(f"_{name}y"), *(F.col(c).alias(f"_by_{c}") for c in by), F.floor(F.col(pos[0]) / size).alias("_cx"), F.floor(F.col(pos[1]) / size).alias("_cy"))

    near = lambda p: F.explode(F.sequence(F.floor((F.col(p) - float(radius) * 1.00005) / size), F.floor((F.col(p) + float(radius) * 1.00005) / size)))
    b = placed(right, "r", right_pos).withColumn("_cx", near("_rx")).withColumn("_cy", near("_ry"))
    pairs = placed(left, "l", left_pos).join(b, ["_cx", "_cy", *(f"_by_{c}" for c in by)])
    d2 = F.pow(F.col("_lx") - F.col("_rx"), 2) + F.pow(F.col("_ly") - F.col("_ry"), 2)
    return pairs.withColumn("dist", F.sqrt(d2)).where(d2 <= float(radius) ** 2).select("l", "r", "dist")
