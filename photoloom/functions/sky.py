"""Gnomonic (TAN) projection as column expressions. ``crpix`` counts pixels from 1, positions count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_sky(x: Column, y: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Right ascension (0 to 360) and declination in degrees of a pixel position."""
    u, v = x + 1 - w["crpix1"], y + 1 - w["crpix2"]
    xi, eta = F.radians(w["cd11"] * u + w["cd12"] * v), F.radians(w["cd21"] * u + w["cd22"] * v)
    d0 = F.radians(w["crval2"])
    across, along = F.cos(d0) - eta * F.sin(d0), F.sin(d0) + eta * F.cos(d0)
    ra = F.pmod(w["crval1"] + F.degrees(F.atan2(xi, across)), F.lit(360.0))
    return ra, F.degrees(F.atan2(along, F.sqrt(xi * xi + across * across)))


def sky_to_pixel(ra: Column, dec: Column, w: dict[str, Column]) -> tuple[Column, Column]:
    """Pixel position (from 0) of a position in degrees; null on the far side of the sky, where the projection has none."""
    a, d, d0 = F.radians(ra - w["crval1"]), F.radians(dec), F.radians(w["crval2"])
    towards = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    towards = F.when(towards > 0, towards)
    xi = F.degrees(F.cos(d) * F.sin(a) / towards)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / towards)
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    u, v = (w["cd22"] * xi - w["cd12"] * eta) / det, (w["cd11"] * eta - w["cd21"] * xi) / det
    return u + w["crpix1"] - 1, v + w["crpix2"] - 1
