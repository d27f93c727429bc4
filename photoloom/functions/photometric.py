"""Scalar formulas of photometry as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Focal length that is assumed where a frame states none (mm).
DEFAULT_FOCAL_MM = 3454.0


def magnitude(flux: Column) -> Column:
    """Instrument magnitude; null for a flux that has none."""
    return F.when(flux > 0, -2.5 * F.log10(flux))


def magnitude_error(flux: Column, error: Column) -> Column:
    return F.when(flux > 0, F.lit(2.5 / math.log(10)) * error / flux)


def quadrature(*errors: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(e, F.lit(2)) for e in errors)))


def aperture_error(variance: Column, gain: Column, area: float, annulus: float, sky_sigma: Column) -> Column:
    return F.sqrt(variance / gain + area * F.pow(sky_sigma, F.lit(2)) * (1 + area / annulus))


def without_background(total: Column, annulus_total: Column, area: float, annulus: float) -> Column:
    return total - annulus_total * area / annulus


def field_of_view_arcmin(pixels: Column, pixel_um: Column, focal_mm: Column) -> Column:
    chip_mm = pixels * pixel_um / 1000
    return 2 * F.atan(chip_mm / F.coalesce(focal_mm, F.lit(DEFAULT_FOCAL_MM)) / 2) * (180 / math.pi) * 60


def inside(x: Column, n: Column, border: float) -> Column:
    """Strictly more than ``border`` from both edges of ``n`` pixels."""
    return (x > border) & (x < n - 1 - border)


def inverse_affine(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """The point that the matrix (two rows of three) maps to (x, y)."""
    a11, a12, a13, a21, a22, a23 = m
    det, u, v = a11 * a22 - a12 * a21, x - a13, y - a23
    return (a22 * u - a12 * v) / det, (a11 * v - a21 * u) / det


def julian_date(at: Column) -> Column:
    """Julian date of a timestamp (a zone-less one is taken in the session's zone, UTC)."""
    return F.unix_micros(at.cast("timestamp")) / F.lit(86_400e6) + F.lit(2_440_587.5)


def phase(jd: Column, epoch: Column, period: Column) -> Column:
    turns = (jd - epoch) / period
    return turns - F.floor(turns)


def distance_kpc(parallax_mas: Column) -> Column:
    return F.when(parallax_mas > 0, 1 / parallax_mas)


def in_open_box(x: Column, centre: float, half: float) -> Column:
    return (x > centre - half) & (x < centre + half)


def sdss_r(v: Column, r: Column) -> Column:
    """r of the SDSS system from V and R (Jordi and others 2005; fixed values)."""
    colour = v - r
    return F.when(colour <= 0.93, r + 0.267 * colour + 0.088).otherwise(r + 0.77 * colour - 0.37)


def sdss_g(b: Column, v: Column) -> Column:
    """g of the SDSS system from B and V (Jordi and others 2005; fixed values)."""
    return v + 0.63 * (b - v) - 0.124


def sdss_u(u: Column, b: Column, v: Column) -> Column:
    """u of the SDSS system from U, B and V (Jordi and others 2005; fixed values)."""
    return sdss_g(b, v) + 0.75 * (u - b) + 0.77 * (b - v) + 0.72


def sdss_i(r: Column, i: Column) -> Column:
    """i of the SDSS system from R and I (Jordi and others 2005; fixed values)."""
    return i + 0.247 * (r - i) + 0.236


def sdss_z(v: Column, r: Column, i: Column) -> Column:
    """z of the SDSS system from V, R and I (Jordi and others 2005; fixed values)."""
    return sdss_r(v, r) - 1.584 * (r - i) + 0.386


#: Effective wavelengths in angstroms (fixed values).
EFFECTIVE_WAVELENGTH = {"U": 3600.0, "B": 4380.0, "V": 5450.0, "R": 6410.0, "I": 7980.0}


def galactic_curve(ratio: float) -> list[tuple[float, float]]:
    """Knots of the mean Galactic curve: inverse micrometres, extinction for each magnitude of E(B-V), for a ratio R of total to
    selective extinction (Fitzpatrick 1999; fixed values)."""
    slope = -0.824 + 4.717 / ratio
    base = ratio + 2.030 - 3.007 * slope
    return [
        (0.0, 0.0),
        (0.377, 0.265 * ratio / 3.1),
        (0.820, 0.829 * ratio / 3.1),
        (1.667, -0.426 + 1.0044 * ratio),
        (1.828, -0.050 + 1.0016 * ratio),
        (2.141, 0.701 + 1.0016 * ratio),
        (2.433, 1.208 + 1.0032 * ratio - 0.00033 * ratio**2),
        (3.704, base + slope * 3.704 + 0.6492006),
        (3.846, base + slope * 3.846 + 0.8752775),
    ]


def cubic_spline(knots: list[tuple[float, float]], at: float) -> float:
    """The cubic spline through the knots whose outer two pieces are one cubic at either end (no condition at the ends)."""
    x, y = np.array(knots, dtype=float).T
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    # Second derivatives: continuous first derivatives inside, one third derivative across the outermost inner knots.
    a, b = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1] / 6, (h[k - 1] + h[k]) / 3, h[k] / 6
        b[k] = slope[k] - slope[k - 1]
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = int(np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2))
    u, v = x[k + 1] - at, at - x[k]
    return float((m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v)


def extinction_at(wavelength: float, colour_excess: float, ratio: float = 3.1) -> float:
    """Extinction at a wavelength (angstroms)."""
    return colour_excess * cubic_spline(galactic_curve(ratio), 1e4 / wavelength)


def extinction_bv(colour_excess: float, ratio: float = 3.1) -> tuple[float, float]:
    """Extinction in V and B of a colour excess E(B-V)."""
    return ratio * colour_excess, (ratio + 1) * colour_excess


def piecewise_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, null beyond the first and the last."""
    knots = sorted(knots)
    out = F.when(x == knots[-1][0], F.lit(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when((x >= x0) & (x < x1), y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return out


def extrapolated_linear(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between the knots, and on along the first and the last piece beyond them."""
    knots = sorted(knots)
    out = None
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        piece = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        out = piece if out is None else F.when(x < x1, piece).otherwise(out)
    return out
