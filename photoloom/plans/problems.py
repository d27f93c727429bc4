"""Queries of the general problems over a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.operators.grid import exposure_odometer_grid, gaps_found, light_curve_grid
from photoloom.operators.spikes import score_readings, spikes_found
from photoloom.operators.units import positions_found, units_inferred
from photoloom.plans.registry import r
from photoloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_found(table(spark, sf_dir, "calib"), table(spark, sf_dir, "catalog_info"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes_found(table(spark, sf_dir, "photometry"), table(spark, sf_dir, "frames"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps_found(table(spark, sf_dir, "photometry"), table(spark, sf_dir, "frames"))


def p1_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture says of rows robbed of their units."""
    return units_inferred(table(spark, sf_dir, "calib"), table(spark, sf_dir, "catalog_info"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with its score and the rules it breaks."""
    return score_readings(table(spark, sf_dir, "photometry"), table(spark, sf_dir, "frames"))


def _grid_columns(grid: DataFrame, *keys: str) -> DataFrame:
    return grid.select(*keys, "night", "slot", "n_readings", r("mean_value", 9).alias("mean_value"), F.coalesce(r("mean_value", 9), r("filled_value", 5)).alias("filled_value"), r("increment", 4).alias("increment"), "missing")


def p3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series themselves, missing cells filled and marked, with the readings spread over the cells as increments."""
    return _grid_columns(light_curve_grid(table(spark, sf_dir, "photometry"), table(spark, sf_dir, "frames")), "object_id", "filter_name")


def p3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative counter with resets on the grid."""
    return _grid_columns(exposure_odometer_grid(table(spark, sf_dir, "frames")), "object_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_inferred": p1_inferred, "p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found, "p3_series": p3_series, "p3_counter": p3_counter,
}


def _sql_grid(source: str, keys: str, rise: str) -> str:
    """The regular grid of ``source`` (keys, t, v, c): lags, cells between two readings, shares by overlap."""
    return f"""
        WITH im AS (SELECT image_id, coalesce(min(jd), min(epoch_us(date_obs) / 86400e6 + 2440587.5)) AS jd FROM frames GROUP BY image_id),
        d AS (SELECT *, floor(t)::BIGINT AS night, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lag(c) OVER w AS c0 FROM ({source}) s WINDOW w AS (PARTITION BY {keys}, floor(t) ORDER BY t, v, c)),
        e AS (SELECT *, floor(t * 144)::BIGINT AS s1, coalesce(floor(t0 * 144)::BIGINT, floor(t * 144)::BIGINT) AS s0, {rise} AS rise FROM d),
        x AS (SELECT *, unnest(generate_series(s0, s1)) AS slot FROM e),
        y AS (SELECT *, CASE WHEN t - t0 > 0 THEN greatest(least(t, (slot + 1) / 144) - greatest(t0, slot / 144), 0) / (t - t0) WHEN slot = s1 THEN 1.0 ELSE 0.0 END AS share FROM x),
        z AS (SELECT {keys}, night, slot, count(*) FILTER (slot = s1) AS n_readings, avg(v) FILTER (slot = s1) AS mean_value, sum(rise * share) AS increment,
              max(v0 + (v - v0) * ((slot + 0.5) / 144 - t0) / (t - t0)) FILTER (slot > s0 AND slot < s1) AS between_ FROM y GROUP BY ALL)
        SELECT {keys}, night, slot, n_readings, round(mean_value, 9) AS mean_value, coalesce(round(mean_value, 9), round(between_, 5)) AS filled_value, round(increment, 4) AS increment, n_readings = 0 AS missing FROM z"""


ORACLES: dict[str, str] = {
    "p3_series": _sql_grid("SELECT object_id, filter_name, jd AS t, mag_cali_trans AS v, NULL AS c FROM photometry JOIN im USING (image_id) WHERE mag_cali_trans IS NOT NULL AND object_id IS NOT NULL", "object_id, filter_name", "CASE WHEN t0 IS NOT NULL THEN 1.0 END"),
    "p3_counter": _sql_grid(
        """SELECT object_name, jd AS t, exptime AS v, fmod(sum(exptime) OVER (PARTITION BY object_name, floor(jd) ORDER BY jd, image_id), 1000.0) AS c
           FROM (SELECT image_id, min(object_name) AS object_name, min(exptime) AS exptime FROM frames WHERE object_name IS NOT NULL AND exptime IS NOT NULL GROUP BY image_id) JOIN im USING (image_id)""",
        "object_name",
        "CASE WHEN t0 IS NOT NULL THEN CASE WHEN c >= c0 THEN c - c0 ELSE c END END",
    ),
    "p3_found": """
        WITH im AS (SELECT image_id, coalesce(min(jd), min(epoch_us(date_obs) / 86400e6 + 2440587.5)) AS jd FROM frames GROUP BY image_id),
        s AS (SELECT DISTINCT object_id, filter_name, floor(jd)::BIGINT AS n, floor(jd * 144)::BIGINT AS slot
              FROM photometry JOIN im USING (image_id) WHERE mag_cali_trans IS NOT NULL AND object_id IS NOT NULL),
        r AS (SELECT object_id, filter_name, n, min(slot) AS a, max(slot) AS b FROM s GROUP BY ALL),
        e AS (SELECT object_id, filter_name, n, unnest(generate_series(a, b)) AS slot FROM r)
        SELECT object_id, filter_name, slot FROM e ANTI JOIN s USING (object_id, filter_name, n, slot)""",
}
