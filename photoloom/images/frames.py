"""Image operators over DataFrames: a frame is one row (ny, nx, pixels as an array, row by row)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.images import kernels as K

SOURCES = "x double, y double, peak double, flux double, flux_err double, sky double"


def plane(row) -> np.ndarray:
    return np.asarray(row["pixels"], float).reshape(int(row["ny"]), int(row["nx"]))


def extract(frames: DataFrame, *, key: str = "image_id", fwhm: float = 4.0, threshold: float = 5.0, radius: float = 5.0, inner: float = 7.0, outer: float = 10.0, gain: float = 1.0) -> DataFrame:
    """Find the stars of each frame and measure them: one row for each star. Frames are worked on one at a time."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                image = plane(row)
                stars = K.find_stars(image, fwhm, threshold)
                flux = K.aperture_photometry(image, stars[:, 0], stars[:, 1], radius, inner, outer, gain)
                yield pd.DataFrame({key: row[key], "x": stars[:, 0], "y": stars[:, 1], "peak": stars[:, 2], "flux": flux[:, 0], "flux_err": flux[:, 1], "sky": flux[:, 2]})

    return frames.select(key, "ny", "nx", "pixels").mapInPandas(work, f"{key} {dict(frames.dtypes)[key]}, {SOURCES}")


def combine(frames: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    """Clipped stack of the frames of each group (a night's flats of a filter, say). For groups that exceed a task's memory, explode
    the pixels and aggregate them by position instead (query ``pixel_stack``)."""
    kinds = dict(frames.dtypes)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        cube = np.stack([plane(row) for _, row in pdf.iterrows()])
        out = K.stack(cube, how=how)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "n": [len(cube)], "ny": [out.shape[0]], "nx": [out.shape[1]], "pixels": [out.ravel()]})

    return frames.select(*by, "ny", "nx", "pixels").groupBy(*by).applyInPandas(work, ", ".join(f"{b} {kinds[b]}" for b in by) + ", n int, ny int, nx int, pixels array<double>")


def shifts(frames: DataFrame, reference: np.ndarray, *, key: str = "image_id") -> DataFrame:
    """``key``, dy, dx: the shift of each frame onto the reference."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(row[key], *K.shift_between(reference, plane(row))) for _, row in pdf.iterrows()]
            yield pd.DataFrame(out, columns=[key, "dy", "dx"])

    return frames.select(key, "ny", "nx", "pixels").mapInPandas(work, f"{key} {dict(frames.dtypes)[key]}, dy int, dx int")


def reduce(frames: DataFrame, masters: DataFrame, *, key: str = "image_id", gain: float = 1.0, read_noise: float = 5.0, rate: bool = True, cosmics: bool = True) -> DataFrame:
    """Reduced frames: ``key``, ny, nx, pixels, error, mask.

    ``frames`` has ``key``, exptime, ny, nx, pixels and the identifiers of its masters (bias_id, dark_id, flat_id, null for none),
    ``masters`` has master_id, exptime, pixels.  Bias, dark (scaled in time), flat, gain, masks of pixels below zero, hot pixels of
    the dark and cosmic rays, then electrons a second.  A frame meets each of its masters in an equi-join, and is worked on alone,
    so a task holds one frame and three masters.  A frame without pixels has no row; a master that is missing is a step left out.
    """
    d = frames.where("pixels IS NOT NULL").select(key, "exptime", "ny", "nx", "pixels", "bias_id", "dark_id", "flat_id")
    for kind in ("bias", "dark", "flat"):
        m = masters.select(F.col("master_id").alias(f"{kind}_id"), F.col("exptime").alias(f"{kind}_exptime"), F.col("pixels").alias(f"{kind}_pixels"))
        d = d.join(m, f"{kind}_id", "left")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shape = int(row["ny"]), int(row["nx"])
                image, bias, dark, flat = (None if row[k] is None else np.asarray(row[k], float).reshape(shape) for k in ("pixels", "bias_pixels", "dark_pixels", "flat_pixels"))
                out = K.reduce_frame(image, row["exptime"], bias, dark, row["dark_exptime"], flat, gain)
                error = K.deviation(image - (0 if bias is None else bias), gain, read_noise) * gain
                mask = ~np.isfinite(out) | (out < 0)
                if dark is not None:
                    mask |= K.hot_pixels(dark - (0 if bias is None else bias))[0]
                if cosmics:
                    hits = K.cosmic_rays(np.nan_to_num(out), error)
                    out = K.clean(out, hits)
                scale = row["exptime"] if rate else 1.0
                yield pd.DataFrame({key: [row[key]], "ny": [shape[0]], "nx": [shape[1]], "pixels": [(out / scale).ravel()], "error": [(error / scale).ravel()], "mask": [mask.ravel()]})

    return d.mapInPandas(work, f"{key} {dict(frames.dtypes)[key]}, ny int, nx int, pixels array<double>, error array<double>, mask array<boolean>")


def combine_by_pixel(frames: DataFrame, by: list[str], *, low: float = 5.0, high: float = 5.0, tile: int = 4096) -> DataFrame:
    """The stack of ``combine`` for groups of any number of frames: ``by``, ny, nx, tile, pixels (of that tile).  Frames are cut
    into tiles of pixels first, so a task holds one tile of a group instead of all its frames."""
    kinds = dict(frames.dtypes)
    cut_ = F.transform(F.sequence(F.lit(0), F.floor((F.size("pixels") - 1) / tile).cast("int")), lambda k: F.struct(k.alias("tile"), F.slice("pixels", k * tile + 1, tile).alias("part")))
    d = frames.where("size(pixels) > 0").select(*by, "ny", "nx", F.inline(cut_))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = K.stack(np.stack(pdf["part"].to_list()), low, high)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "ny": [pdf["ny"].iloc[0]], "nx": [pdf["nx"].iloc[0]], "tile": [pdf["tile"].iloc[0]], "pixels": [out]})

    return d.groupBy(*by, "ny", "nx", "tile").applyInPandas(work, ", ".join(f"{b} {kinds[b]}" for b in by) + ", ny int, nx int, tile int, pixels array<double>")


def limits(frames: DataFrame, *, key: str = "image_id", radius: float = 5.0, zero_point: str = "zp") -> DataFrame:
    """``key``, flux_limit, mag_limit: the faintest star that each frame shows at five sigmas (stars that are found are masked)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                image = plane(row)
                sky = image - K.background(image)[0]
                mask = np.zeros(image.shape, bool)
                jj, ii = np.mgrid[: image.shape[0], : image.shape[1]]
                for x, y in K.find_stars(image)[:, :2]:
                    mask |= np.hypot(ii - x, jj - y) <= 2 * radius
                flux = K.limiting_flux(sky, mask, radius)
                yield pd.DataFrame({key: [row[key]], "flux_limit": [flux], "mag_limit": [row[zero_point] - 2.5 * np.log10(flux) if flux > 0 else np.nan]})

    return frames.select(key, "ny", "nx", "pixels", zero_point).mapInPandas(work, f"{key} {dict(frames.dtypes)[key]}, flux_limit double, mag_limit double")
