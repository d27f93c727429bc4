"""Clipped and plain aggregates, calibration, normalisation, reshaping, top-k, Monte Carlo."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.functions import photometric as P
from photoloom.functions.random import normal_sample
from photoloom.functions.sky import pixel_to_sky
from photoloom.operators.clip import array_mean, array_median, array_std, sigma_clip_counted, sigma_clip_flags, sigma_clip_stats
from photoloom.operators.nearest import unambiguous
from photoloom.operators.spatial import sky_pairs
from photoloom.operators.spikes import image_times
from photoloom.plans.projections import SQL_TIMES, WCS, WCS_COLUMNS, solutions, sql_separation, sql_sky
from photoloom.plans.registry import Registry, Tables, r, sql_clip, sql_values

query = Registry()
c = F.col
STATS = "count(*) AS n, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median, round(stddev_pop(v), 7) AS std"


def _stats(df):
    # Means of values with four decimals fall on ties of the sixth.
    return df.withColumns({"mean": r("mean", 9), "median": r("median", 9), "std": r("std", 7)}).where("n > 0")


@query("clip_airmass", f"WITH {sql_clip('SELECT object_name, filter_name, airmass AS v FROM frames', 'object_name, filter_name', 1.5, centre='mean')} SELECT object_name, filter_name, {STATS} FROM c5 GROUP BY ALL")
def clip_airmass(t):
    """Every series; frames without an object name are series of their own."""
    return _stats(sigma_clip_counted(t.frames, ["object_name", "filter_name"], "airmass", 1.5, centre="mean"))


@query("clip_zero_points", f"WITH {sql_clip('SELECT image_id, mag_cali_no_trans - mags_fit AS v FROM photometry WHERE mag_cali_no_trans BETWEEN 5 AND 30', 'image_id', 1.5)} SELECT image_id, {STATS} FROM c5 GROUP BY ALL")
def clip_zero_points(t):
    return _stats(sigma_clip_stats(t.photometry.where("mag_cali_no_trans BETWEEN 5 AND 30"), ["image_id"], c("mag_cali_no_trans") - c("mags_fit"), 1.5))


@query("clip_flux_image", f"WITH {sql_clip('SELECT image_id, flux_fit AS v FROM photometry WHERE flux_fit <> 0', 'image_id', 1.5)} SELECT image_id, {STATS} FROM c5 GROUP BY ALL")
def clip_flux_image(t):
    return _stats(sigma_clip_stats(t.photometry.where("flux_fit <> 0"), ["image_id"], "flux_fit", 1.5))


_SERIES = "object_id, filter_name"


@query("clip_mag_object", f"WITH {sql_clip(f'SELECT {_SERIES}, mag_cali_trans AS v FROM photometry', _SERIES, 1.5)} SELECT {_SERIES}, {STATS} FROM c5 GROUP BY ALL")
def clip_mag_object(t):
    """Each object and filter over all frames."""
    return _stats(sigma_clip_counted(t.photometry, ["object_id", "filter_name"], "mag_cali_trans", 1.5))


_TEMPERATURES = f"SELECT DISTINCT image_id, instrume, floor(i.jd)::BIGINT AS night, ccd_temp FROM frames JOIN {SQL_TIMES} i USING (image_id) WHERE ccd_temp IS NOT NULL"


@query("clip_temperature", f"""WITH f AS ({_TEMPERATURES}), {sql_clip('SELECT instrume, night, ccd_temp AS v FROM f', 'instrume, night', 2.0)}, d AS (SELECT instrume, night, stddev_pop(ccd_temp) AS s0 FROM f GROUP BY ALL)
    SELECT image_id, s0 > 5.0 AND NOT ccd_temp BETWEEN m - 2.0 * s AND m + 2.0 * s AS clipped FROM f JOIN b4 ON f.instrume IS NOT DISTINCT FROM b4.instrume AND f.night IS NOT DISTINCT FROM b4.night JOIN d ON f.instrume IS NOT DISTINCT FROM d.instrume AND f.night IS NOT DISTINCT FROM d.night""")
def clip_temperature(t):
    """Frames of every instrument and night whose temperature is off, where the night's temperatures scatter beyond the
    tolerance; a missing jd is taken from date_obs."""
    f = t.frames.where("ccd_temp IS NOT NULL").select("image_id", "instrume", "ccd_temp").distinct().join(image_times(t.frames), "image_id")
    f = f.select("image_id", "instrume", F.floor("jd").cast("long").alias("night"), "ccd_temp")
    return sigma_clip_flags(f, ["instrume", "night"], "ccd_temp", 2.0, tolerance=5.0).select("image_id", "clipped")


@query("clip_background", f"WITH {sql_clip('SELECT image_id, flux_err AS v FROM photometry', 'image_id', 5.0, spread='mad')} SELECT image_id, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std FROM c5 GROUP BY image_id")
def clip_background(t):
    """Sky level and noise of each image: 5 sigma clipping with the scaled median absolute deviation."""
    g = sigma_clip_stats(t.photometry, ["image_id"], "flux_err", 5.0, spread="mad").where("n > 0")
    return g.select("image_id", "n", r("median").alias("median"), r("std").alias("std"))


_RA, _DEC = sql_sky("x_fit", "y_fit")
_CALIBRATORS = f"""WITH m AS (SELECT DISTINCT image_id, filter_name, object_id, mags_fit, {_RA} AS ra, {_DEC} AS dec FROM photometry JOIN {WCS} w USING (image_id) WHERE x_fit IS NOT NULL AND y_fit IS NOT NULL AND mags_fit IS NOT NULL),
    k AS (SELECT DISTINCT auid, ra_deg, dec_deg, mag_v, mag_b FROM comp_stars),
    p AS (SELECT image_id, filter_name, object_id, mags_fit, auid, mag_v, mag_b FROM m JOIN k ON abs(dec - dec_deg) < 0.001 AND {sql_separation('ra', 'dec', 'ra_deg', 'dec_deg')} <= 2),
    p1 AS (SELECT *, count(*) OVER (PARTITION BY image_id, object_id) AS n FROM p), p2 AS (SELECT *, count(*) OVER (PARTITION BY image_id, auid) AS n2 FROM p1 WHERE n = 1),
    z AS (SELECT image_id, filter_name, auid, object_id, mag_b - mag_v AS colour, CASE filter_name WHEN 'V' THEN mag_v WHEN 'B' THEN mag_b END - mags_fit AS v FROM p2 WHERE n2 = 1)"""


def zero_points(t: Tables):
    """image_id, auid, object_id, v: literature less instrument magnitude of every star that is matched beyond doubt."""
    rows = t.photometry.where("x_fit IS NOT NULL AND y_fit IS NOT NULL AND mags_fit IS NOT NULL").select("image_id", "filter_name", "object_id", "mags_fit", "x_fit", "y_fit").distinct()
    rows = rows.join(solutions(t), "image_id")
    ra, dec = pixel_to_sky(c("x_fit"), c("y_fit"), {x: c(x) for x in WCS_COLUMNS})
    rows = rows.select("image_id", "filter_name", "object_id", "mags_fit", ra.alias("ra_deg"), dec.alias("dec_deg"))
    pairs = sky_pairs(rows, t.comp_stars.select("auid", "ra_deg", "dec_deg", "mag_v", "mag_b").distinct(), 2, spread_by="image_id")
    d = unambiguous(pairs.select("l.image_id", "l.filter_name", "l.object_id", "l.mags_fit", "r.auid", "r.mag_v", "r.mag_b"), ["image_id", "object_id"], ["image_id", "auid"])
    literature = F.when(c("filter_name") == "V", c("mag_v")).when(c("filter_name") == "B", c("mag_b"))
    return d.select("image_id", "filter_name", "auid", "object_id", (c("mag_b") - c("mag_v")).alias("colour"), (literature - c("mags_fit")).alias("v"))


@query("zp", f"{_CALIBRATORS} SELECT image_id, auid, object_id, round(v, 6) AS zp FROM z WHERE v IS NOT NULL")
def zp(t):
    return zero_points(t).where("v IS NOT NULL").select("image_id", "auid", "object_id", r("v").alias("zp"))


@query("calibrate_simple", f"{_CALIBRATORS}, {sql_clip('SELECT image_id, v FROM z', 'image_id', 1.5)}, g AS (SELECT image_id, count(*) AS n, quantile_cont(v, 0.5) AS m, stddev_pop(v) AS s FROM c5 GROUP BY ALL) SELECT image_id, object_id, filter_name, n AS n_cal, round(mags_fit + m, 6) AS mag, round(s, 6) AS mag_std FROM (SELECT DISTINCT image_id, object_id, filter_name, mags_fit FROM photometry WHERE mags_fit IS NOT NULL) JOIN g USING (image_id)")
def calibrate_simple(t):
    """The flagship: magnitudes of all objects from the clipped zero point of their image.

    Adding a magnitude to all zero points and clipping gives the same stars, median and spread as clipping the zero points and
    adding it afterwards; so the product of objects and calibrators is never formed.
    """
    g = sigma_clip_stats(zero_points(t).where("v IS NOT NULL"), ["image_id"], "v", 1.5).select("image_id", c("n").alias("n_cal"), "median", "std")
    m = t.photometry.where("mags_fit IS NOT NULL").select("image_id", "object_id", "filter_name", "mags_fit").distinct()
    return m.join(g, "image_id").select("image_id", "object_id", "filter_name", "n_cal", r(c("mags_fit") + c("median")).alias("mag"), r("std").alias("mag_std"))


@query("zp_statistic", f"{_CALIBRATORS} SELECT image_id, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 9) AS mean, round(stddev_pop(v), 7) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM z WHERE v IS NOT NULL GROUP BY image_id")
def zp_statistic(t):
    z = zero_points(t).where("v IS NOT NULL").groupBy("image_id")
    return z.agg(F.count("*").alias("n"), r(F.percentile("v", 0.5)).alias("median"), r(F.avg("v"), 9).alias("mean"), r(F.stddev_pop("v"), 7).alias("std"), r(F.min("v")).alias("least"), r(F.max("v")).alias("most"))


@query("transform_derive", f"{_CALIBRATORS} SELECT image_id, filter_name, count(*) AS n, round(regr_slope(v, colour), 4) AS term, round(regr_intercept(v, colour), 4) AS zero FROM z WHERE v IS NOT NULL AND colour IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def transform_derive(t):
    """Colour term and zero point of each image: the fit of literature less instrument magnitude against literature colour."""
    z = zero_points(t).where("v IS NOT NULL AND colour IS NOT NULL").groupBy("image_id", "filter_name")
    return z.agg(F.count("*").alias("n"), r(F.regr_slope("v", "colour"), 4).alias("term"), r(F.regr_intercept("v", "colour"), 4).alias("zero")).where("n >= 5")


@query("protected_objects", f"""WITH d AS (SELECT DISTINCT image_id, object_id, filter_name FROM photometry), n AS (SELECT filter_name, count(DISTINCT image_id) AS n FROM d GROUP BY 1),
    k AS (SELECT filter_name, object_id, count(*) AS k FROM d GROUP BY ALL) SELECT filter_name, object_id, k AS n_images FROM k WHERE k >= 60 OR object_id % 97 = 0""")
def protected_objects(t):
    """Objects seen often enough, and protected ones however often they are seen."""
    k = t.photometry.select("image_id", "object_id", "filter_name").distinct().groupBy("filter_name", "object_id").agg(F.count("*").alias("n_images"))
    return k.where((c("n_images") >= 60) | (c("object_id") % 97 == 0))


@query("quasi_flux", f"WITH {sql_clip('SELECT image_id, flux_fit AS v FROM photometry WHERE flux_fit <> 0', 'image_id', 1.5)}, g AS (SELECT image_id, quantile_cont(v, 0.5) AS m FROM c5 GROUP BY ALL) SELECT image_id, object_id, round(flux_fit / m, 9) AS flux FROM photometry JOIN g USING (image_id) WHERE m <> 0")
def quasi_flux(t):
    g = sigma_clip_stats(t.photometry.where("flux_fit <> 0"), ["image_id"], "flux_fit", 1.5).where("median <> 0").select("image_id", "median")
    return t.photometry.join(g, "image_id").select("image_id", "object_id", r(c("flux_fit") / c("median"), 9).alias("flux"))


@query("flux_normalization", f"""WITH {sql_clip(f'SELECT {_SERIES}, flux_fit AS v FROM photometry WHERE flux_fit <> 0', _SERIES, 1.5)}, g AS (SELECT {_SERIES}, quantile_cont(v, 0.5) AS m FROM c5 GROUP BY ALL)
    SELECT image_id, p.object_id, round(flux_fit / m, 9) AS flux FROM photometry p JOIN g ON p.object_id IS NOT DISTINCT FROM g.object_id AND p.filter_name IS NOT DISTINCT FROM g.filter_name WHERE flux_fit <> 0 AND m <> 0""")
def flux_normalization(t):
    """Fluxes over the clipped median of their object and filter in all frames."""
    d = t.photometry.where("flux_fit <> 0").select("image_id", "object_id", "filter_name", "flux_fit")
    g = sigma_clip_counted(d, ["object_id", "filter_name"], "flux_fit", 1.5).where("median <> 0")
    g = g.select(c("object_id").alias("_o"), c("filter_name").alias("_f"), "median")
    same = c("object_id").eqNullSafe(c("_o")) & c("filter_name").eqNullSafe(c("_f"))
    return d.join(g, same).select("image_id", "object_id", r(c("flux_fit") / c("median"), 9).alias("flux"))


@query("image_statistics", "SELECT image_id, count(flux_fit) AS n, round(avg(flux_fit), 4) AS mean, round(quantile_cont(flux_fit, 0.5), 4) AS median, round(quantile_cont(flux_fit, 0.99), 4) AS p99, round(stddev_pop(flux_fit), 4) AS std, min(flux_fit) AS least, max(flux_fit) AS most FROM photometry GROUP BY image_id")
def image_statistics(t):
    return t.photometry.groupBy("image_id").agg(F.count("flux_fit").alias("n"), r(F.avg("flux_fit"), 4).alias("mean"), r(F.percentile("flux_fit", 0.5), 4).alias("median"), r(F.percentile("flux_fit", 0.99), 4).alias("p99"), r(F.stddev_pop("flux_fit"), 4).alias("std"), F.min("flux_fit").alias("least"), F.max("flux_fit").alias("most"))


@query("unique_counts", "SELECT image_id, count(*) AS n, count(DISTINCT object_id) AS n_objects FROM photometry GROUP BY image_id HAVING count(*) > count(DISTINCT object_id)")
def unique_counts(t):
    return t.photometry.groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("n_objects")).where("n > n_objects")


@query("uniqueness_guard", "SELECT object_name, count(DISTINCT gain) AS gains, count(DISTINCT naxis1) AS widths, count(DISTINCT xbinning) AS binnings FROM frames WHERE object_name IS NOT NULL GROUP BY object_name")
def uniqueness_guard(t):
    return t.frames.where("object_name IS NOT NULL").groupBy("object_name").agg(*(F.countDistinct(a).alias(b) for a, b in (("gain", "gains"), ("naxis1", "widths"), ("xbinning", "binnings"))))


@query("linear_fit", "SELECT catalog_code, count(*) AS n, round(regr_slope(mag_v, mag_b - mag_v), 4) AS slope, round(regr_intercept(mag_v, mag_b - mag_v), 4) AS intercept FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL GROUP BY catalog_code")
def linear_fit(t):
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL").withColumn("x", c("mag_b") - c("mag_v"))
    return d.groupBy("catalog_code").agg(F.count("*").alias("n"), r(F.regr_slope("mag_v", "x"), 4).alias("slope"), r(F.regr_intercept("mag_v", "x"), 4).alias("intercept"))


@query("weighted_fit", """SELECT catalog_code, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 4) AS slope, round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 4) AS intercept, round(s / (s * sxx - sx * sx), 6) AS slope_variance
    FROM (SELECT catalog_code, sum(w) s, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy, count(*) n FROM (SELECT catalog_code, mag_b - mag_v AS x, mag_v - 14 AS y, 1 / pow(err_v, 2) AS w FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL AND err_v > 0) GROUP BY catalog_code) WHERE n > 2""")
def weighted_fit(t):
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL AND err_v > 0").select("catalog_code", (c("mag_b") - c("mag_v")).alias("x"), (c("mag_v") - 14).alias("y"), (1 / F.pow("err_v", F.lit(2))).alias("w"))
    sums = {"s": c("w"), "sx": c("w") * c("x"), "sy": c("w") * c("y"), "sxx": c("w") * c("x") * c("x"), "sxy": c("w") * c("x") * c("y")}
    g = d.groupBy("catalog_code").agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in sums.items())).where("n > 2")
    det = c("s") * c("sxx") - c("sx") * c("sx")
    return g.select("catalog_code", r((c("s") * c("sxy") - c("sx") * c("sy")) / det, 4).alias("slope"), r((c("sxx") * c("sy") - c("sx") * c("sxy")) / det, 4).alias("intercept"), r(c("s") / det).alias("slope_variance"))


@query("width_bins", "SELECT bin, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median FROM (SELECT floor((mag_v - 8) / 0.5)::BIGINT AS bin, mag_b - mag_v AS v FROM calib WHERE mag_v IS NOT NULL AND mag_b IS NOT NULL) GROUP BY bin")
def width_bins(t):
    d = t.calib.where("mag_v IS NOT NULL AND mag_b IS NOT NULL").select(F.floor((c("mag_v") - 8) / 0.5).cast("long").alias("bin"), (c("mag_b") - c("mag_v")).alias("v"))
    return d.groupBy("bin").agg(F.count("*").alias("n"), r(F.percentile("v", 0.5)).alias("median"))


@query("clip_fiducial", f"WITH {sql_clip('SELECT floor((mag_v - 8) / 0.5)::BIGINT AS bin, mag_b - mag_v AS v FROM calib WHERE mag_v IS NOT NULL AND mag_b IS NOT NULL', 'bin', 3.0)} SELECT bin, {STATS} FROM c5 GROUP BY ALL")
def clip_fiducial(t):
    d = t.calib.where("mag_v IS NOT NULL AND mag_b IS NOT NULL").withColumn("bin", F.floor((c("mag_v") - 8) / 0.5).cast("long"))
    return _stats(sigma_clip_counted(d, ["bin"], c("mag_b") - c("mag_v"), 3.0))


@query("histogram", "SELECT filter_name, floor(mags_fit / 0.25)::BIGINT AS bin, count(*) AS n FROM photometry WHERE mags_fit IS NOT NULL GROUP BY ALL")
def histogram(t):
    return t.photometry.where("mags_fit IS NOT NULL").groupBy("filter_name", F.floor(c("mags_fit") / 0.25).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_MODELS = [(k, 0.2 * k, -0.1 + 0.05 * k) for k in range(12)]


@query("best_isochrone", f"WITH s AS (SELECT catalog_code, k, sum(pow(mag_b - mag_v - (a + b * (mag_v - 12) / 4), 2)) AS chi2 FROM (SELECT * FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL) JOIN {sql_values(_MODELS, 'k, a, b')} ON true GROUP BY ALL) SELECT catalog_code, arg_min(k, (round(chi2, 6), k)) AS k, round(min(chi2), 4) AS chi2 FROM s GROUP BY catalog_code")
def best_isochrone(t):
    """The model curve with the least sum of squares for each catalogue: one sum for each model of the fixed list, in one pass."""
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL")
    sums = [F.sum(F.pow(c("mag_b") - c("mag_v") - (a + b * (c("mag_v") - 12) / 4), F.lit(2))).alias(f"s{k}") for k, a, b in _MODELS]
    best = F.array_min(F.array(*(F.struct(F.round(f"s{k}", 6).alias("chi2"), F.lit(k).alias("k")) for k, _, _ in _MODELS)))
    return d.groupBy("catalog_code").agg(*sums).select("catalog_code", best.alias("m")).select("catalog_code", "m.k", r("m.chi2", 4).alias("chi2"))


@query("faintest_ten", "SELECT filter_name, round(avg(mag), 9) AS mean, round(quantile_cont(mag, 0.5), 6) AS median FROM (SELECT filter_name, mags_fit AS mag, row_number() OVER (PARTITION BY filter_name ORDER BY mags_fit DESC, object_id, image_id) AS k FROM (SELECT DISTINCT filter_name, mags_fit, object_id, image_id FROM photometry WHERE mags_fit < 30)) WHERE k <= 10 GROUP BY filter_name")
def faintest_ten(t):
    """Limiting magnitude: the ten faintest of each filter. The top ten are found in each partition before anything is shuffled."""
    d = t.photometry.where("mags_fit < 30").select("filter_name", "mags_fit", "object_id", "image_id").distinct()
    top = d.withColumn("_k", F.row_number().over(W.partitionBy("filter_name").orderBy(F.desc("mags_fit"), "object_id", "image_id"))).where("_k <= 10")
    return top.groupBy("filter_name").agg(r(F.avg("mags_fit"), 9).alias("mean"), r(F.percentile("mags_fit", 0.5)).alias("median"))


@query("brightest_100", "SELECT cal_id, mag_v FROM (SELECT DISTINCT cal_id, mag_v FROM calib WHERE mag_v IS NOT NULL) ORDER BY mag_v, cal_id LIMIT 100")
def brightest_100(t):
    return t.calib.where("mag_v IS NOT NULL").select("cal_id", "mag_v").distinct().orderBy("mag_v", "cal_id").limit(100)


@query("top_fifth_by_flux", "SELECT image_id, object_id FROM (SELECT image_id, object_id, percent_rank() OVER (PARTITION BY image_id ORDER BY flux_fit DESC, object_id) AS p FROM (SELECT DISTINCT image_id, object_id, flux_fit FROM photometry WHERE flux_fit IS NOT NULL)) WHERE p < 0.2")
def top_fifth_by_flux(t):
    d = t.photometry.where("flux_fit IS NOT NULL").select("image_id", "object_id", "flux_fit").distinct()
    return d.withColumn("p", F.percent_rank().over(W.partitionBy("image_id").orderBy(F.desc("flux_fit"), "object_id"))).where("p < 0.2").select("image_id", "object_id")


@query("wide_magnitudes", "SELECT object_id, " + ", ".join(f"round(coalesce(avg(mag_cali_trans) FILTER (filter_name = '{f}'), 999.0), 9) AS {f}_transformed, round(coalesce(avg(mag_cali_no_trans) FILTER (filter_name = '{f}'), 999.0), 9) AS {f}_simple" for f in "BVRI") + " FROM photometry WHERE object_id IS NOT NULL GROUP BY object_id")
def wide_magnitudes(t):
    """One row for each object, a column for each filter and kind; 999 where there is none."""
    p = t.photometry.where("object_id IS NOT NULL").groupBy("object_id").pivot("filter_name", list("BVRI")).agg(F.avg("mag_cali_trans").alias("transformed"), F.avg("mag_cali_no_trans").alias("simple"))
    return p.select("object_id", *(r(F.coalesce(f"{f}_{k}", F.lit(999.0)), 9).alias(f"{f}_{k}") for f in "BVRI" for k in ("transformed", "simple")))


@query("long_magnitudes", "SELECT cal_id, 'mag_' || b AS band, v AS mag FROM (SELECT DISTINCT cal_id, mag_u, mag_b, mag_v, mag_r, mag_i FROM calib) s, LATERAL (VALUES ('u', mag_u), ('b', mag_b), ('v', mag_v), ('r', mag_r), ('i', mag_i)) x(b, v) WHERE v IS NOT NULL")
def long_magnitudes(t):
    bands = [f"mag_{b}" for b in "ubvri"]
    return t.calib.select("cal_id", *bands).distinct().unpivot("cal_id", bands, "band", "mag").where("mag IS NOT NULL")


_B, _V = 0.11, 0.047


@query("transform_colour", f"WITH b AS (SELECT object_id, avg(mags_fit) AS b FROM photometry WHERE filter_name = 'B' GROUP BY 1), v AS (SELECT object_id, avg(mags_fit) AS v FROM photometry WHERE filter_name = 'V' GROUP BY 1) SELECT object_id, round(v + 24.3 + {_V!r} / (1 - {_B!r} + {_V!r}) * (b - v), 9) AS v_std FROM b JOIN v USING (object_id)")
def transform_colour(t):
    """Magnitudes with a colour term: C = c2 / (1 - c1 + c2) for the second filter of a pair."""
    d = t.photometry.where("filter_name IN ('B', 'V')").groupBy("object_id").agg(*(F.avg(F.when(c("filter_name") == f, c("mags_fit"))).alias(f.lower()) for f in "BV"))
    term = _V / (1 - _B + _V)
    return d.where("b IS NOT NULL AND v IS NOT NULL").select("object_id", r(c("v") + 24.3 + term * (c("b") - c("v")), 9).alias("v_std"))


#: Colour terms T and k of each filter.
_AIR_TERMS = {"B": (0.11, -0.02), "V": (0.05, -0.012), "R": (0.04, -0.01), "I": (0.03, -0.008)}


@query("transform_air_mass", f"WITH f AS (SELECT image_id, coalesce(min(airmass), 1.0) AS x FROM frames GROUP BY 1), o AS (SELECT object_id, avg(mags_fit) FILTER (filter_name = 'B') - avg(mags_fit) FILTER (filter_name = 'V') AS colour FROM photometry WHERE filter_name IN ('B', 'V') GROUP BY 1) SELECT image_id, object_id, round(mags_fit + 24.3 + (CASE filter_name {' '.join(f'WHEN {b!r} THEN {a!r} - {k!r} * x' for b, (a, k) in _AIR_TERMS.items())} END) * colour, 4) AS mag FROM photometry JOIN f USING (image_id) JOIN o USING (object_id) WHERE colour IS NOT NULL")
def transform_air_mass(t):
    """Colour term that depends on air mass, c = T - k X, for every filter, at the object's own colour."""
    f = t.frames.groupBy("image_id").agg(F.coalesce(F.min("airmass"), F.lit(1.0)).alias("x"))
    mean = {b: F.avg(F.when(c("filter_name") == b, c("mags_fit"))) for b in "BV"}
    colour = t.photometry.where("filter_name IN ('B', 'V')").groupBy("object_id").agg((mean["B"] - mean["V"]).alias("colour")).where("colour IS NOT NULL")
    term = F.coalesce(*(F.when(c("filter_name") == b, a - k * c("x")) for b, (a, k) in _AIR_TERMS.items()))
    return t.photometry.join(f, "image_id").join(colour, "object_id").select("image_id", "object_id", r(c("mags_fit") + 24.3 + term * c("colour"), 4).alias("mag"))


#: Tasks that draws are spread over: their rows are few, but each is work.
DRAW_TASKS = 96


@query("bootstrap_zp", """WITH z AS (SELECT catalog_code, mag_v AS v, row_number() OVER (PARTITION BY catalog_code ORDER BY mag_v, cal_id) - 1 AS k FROM (SELECT DISTINCT cal_id, catalog_code, mag_v FROM calib WHERE mag_v IS NOT NULL)),
    n AS (SELECT catalog_code, count(*) AS n FROM z GROUP BY 1), j AS (SELECT catalog_code, n, unnest(range(CAST(floor(0.6 * n) AS BIGINT))) AS j FROM n WHERE n > 20),
    d AS (SELECT catalog_code, rep, ((rep * 7919 + j * 104729 + rep * j * 31) % n) AS k FROM j, range(1000) a(rep)), m AS (SELECT catalog_code, rep, quantile_cont(v, 0.5) AS m FROM d JOIN z USING (catalog_code, k) GROUP BY ALL)
    SELECT catalog_code, round(quantile_cont(m, 0.5), 6) AS median, round(stddev_pop(m), 6) AS std FROM m GROUP BY catalog_code""")
def bootstrap_zp(t):
    """Median and spread of the medians of 1000 draws of 60 per cent with replacement. Draws are arithmetic on ranks, so they do
    not depend on the layout. The median of a draw is at the median of the drawn ranks: a draw is made of ranks alone, in a task
    of its own, and no value is copied; only the two middle ranks of each draw meet the values. Ranks come from counts of
    value bins and row numbers within the bins, so no task sorts a whole catalogue."""
    z = t.calib.where("mag_v IS NOT NULL").select("cal_id", "catalog_code", "mag_v").distinct().withColumn("bin", F.floor(c("mag_v") * 20))
    bins = z.groupBy("catalog_code", "bin").agg(F.count("*").alias("in_bin"))
    below = W.partitionBy("catalog_code").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(below), F.lit(0)))
    ranked = z.join(bins, ["catalog_code", "bin"]).withColumn("k", c("before") + F.row_number().over(W.partitionBy("catalog_code", "bin").orderBy("mag_v", "cal_id")) - 1)
    size = bins.groupBy("catalog_code").agg(F.sum("in_bin").alias("n")).where("n > 20")
    d = size.select("catalog_code", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("rep")).repartition(DRAW_TASKS, "catalog_code", "rep")
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(0.6 * c("n")) - 1), lambda j: (c("rep") * 7919 + j * 104729 + c("rep") * j * 31) % c("n")))
    d = d.select("catalog_code", "rep", drawn.alias("a")).select("catalog_code", "rep", F.explode(F.array(F.get("a", F.floor((F.size("a") - 1) / 2).cast("int")), F.get("a", F.floor(F.size("a") / 2).cast("int")))).alias("k"))
    m = d.join(ranked.select("catalog_code", "k", "mag_v"), ["catalog_code", "k"]).groupBy("catalog_code", "rep").agg(F.avg("mag_v").alias("m"))
    return m.groupBy("catalog_code").agg(r(F.percentile("m", 0.5)).alias("median"), r(F.stddev_pop("m")).alias("std"))


@query("mc_samples", None)
def mc_samples(t):
    """Monte Carlo summary of each comparison star's V magnitude: median and spread of 1000 normal samples, reproducible under any
    partitioning (samples are hashes of the key and the sample's number)."""
    d = t.comp_stars.where("mag_v IS NOT NULL").select("auid", "mag_v", F.coalesce("err_v", F.lit(0.03)).alias("s")).distinct()
    x = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: c("mag_v") + c("s") * normal_sample(7, c("auid"), k))
    x = d.select("auid", F.sort_array(x).alias("x")).select("auid", "x", array_mean(c("x")).alias("mean"))
    return x.select("auid", r(array_median(c("x"))).alias("median"), r(array_std(c("x"), c("mean"))).alias("std"))
