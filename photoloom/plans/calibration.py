"""Calibration with colour terms, coefficient tables, clips with masks, rules of common objects, set operations of identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.operators.clip import array_mean, array_median, array_std, sigma_clip_counted, sigma_clip_flags, sigma_clip_stats
from photoloom.plans.aggregates import _CALIBRATORS, zero_points
from photoloom.plans.registry import Registry, Tables, r, sql_clip, sql_values
from photoloom.plans.series import _FLUX, _PIX, pixels

query = Registry()
c = F.col

#: Sets of colour terms: valid from, camera, filter, the pair it was measured with, T and k of both filters.
TERMS = [
    (2450000.0, "Tamarisk T300 EMCCD", "B", "B", "V", 0.11, -0.02, 0.047, -0.011),
    (2450060.0, "Tamarisk T300 EMCCD", "B", "B", "V", 0.105, -0.018, 0.05, -0.012),
    (2450000.0, "Tamarisk T300 EMCCD", "V", "B", "V", 0.11, -0.02, 0.047, -0.011),
    (2450000.0, "Orrery Ultra 57", "V", "B", "V", 0.12, -0.021, 0.05, -0.01),
    (2450000.0, "Corvane CV-620M", "V", "V", "R", 0.05, -0.012, 0.03, -0.008),
]
_TERMS = "start_jd, camera, filter, filter_1, filter_2, t1, k1, t2, k2"
_TERM_TYPES = "start_jd double, camera string, filter string, filter_1 string, filter_2 string, t1 double, k1 double, t2 double, k2 double"
#: The pairs of filters that a colour can be made of (fixed values).
PAIRS = [("U", "V"), ("B", "V"), ("V", "R"), ("V", "I")]


def terms(t: Tables) -> DataFrame:
    return t.values(TERMS, _TERM_TYPES)


@query("coeff_lookup", f"""WITH f AS (SELECT DISTINCT image_id, instrume, filter_name FROM frames), s AS (SELECT DISTINCT instrume, filter_name FROM f)
    SELECT f.image_id, v.filter_1, v.filter_2, v.start_jd, v.t1, v.k1, v.t2, v.k2 FROM f JOIN {sql_values(TERMS, _TERMS)} ON f.instrume = v.camera AND f.filter_name = v.filter
    JOIN s a ON a.instrume = f.instrume AND a.filter_name = v.filter_1 JOIN s b ON b.instrume = f.instrume AND b.filter_name = v.filter_2""")
def coeff_lookup(t):
    """The sets that apply to a frame: its camera and filter, measured with a pair of filters that the camera has been used with."""
    f = t.frames.select("image_id", c("instrume").alias("camera"), c("filter_name").alias("filter")).distinct()
    have = f.select("camera", "filter").distinct()
    sets = terms(t).join(have.withColumnRenamed("filter", "filter_1"), ["camera", "filter_1"]).join(have.withColumnRenamed("filter", "filter_2"), ["camera", "filter_2"])
    return f.join(sets, ["camera", "filter"]).select("image_id", "filter_1", "filter_2", "start_jd", "t1", "k1", "t2", "k2")


_COLOURS = f"""{_CALIBRATORS}, o AS (SELECT auid, min(colour) AS x, avg(v) FILTER (filter_name = 'B') AS zb, avg(v) FILTER (filter_name = 'V') AS zv FROM z WHERE v IS NOT NULL AND colour IS NOT NULL GROUP BY auid),
    h AS (SELECT auid, min(nullif(regexp_extract(coalesce(chart, ''), '([0-9]+)', 1), '')) AS chart FROM comp_stars GROUP BY auid)"""


def _observed(t: Tables) -> DataFrame:
    """auid, x (literature colour), zb and zv (mean zero points), chart."""
    z = zero_points(t).where("v IS NOT NULL AND colour IS NOT NULL").groupBy("auid")
    z = z.agg(F.min("colour").alias("x"), *(F.avg(F.when(c("filter_name") == f, c("v"))).alias(f"z{f.lower()}") for f in "BV"))
    chart = t.comp_stars.groupBy("auid").agg(F.min(F.nullif(F.regexp_extract(F.coalesce("chart", F.lit("")), "([0-9]+)", 1), F.lit(""))).alias("chart"))
    return z.where("zb IS NOT NULL AND zv IS NOT NULL").join(chart, "auid")


@query("tcolor", f"{_COLOURS} SELECT chart, count(*) AS n, round(1 / regr_slope(x - (zb - zv), x), 4) AS t_colour, round(regr_slope(zb, x), 4) AS t_b, round(regr_slope(zv, x), 4) AS t_v FROM o JOIN h USING (auid) WHERE zb IS NOT NULL AND zv IS NOT NULL GROUP BY chart HAVING count(*) >= 5")
def tcolor(t):
    """Colour term of each chart, one over the slope of observed against literature colour, and the terms of both filters."""
    seen = c("x") - (c("zb") - c("zv"))
    g = _observed(t).groupBy("chart").agg(F.count("*").alias("n"), r(1 / F.regr_slope(seen, c("x")), 4).alias("t_colour"), r(F.regr_slope("zb", "x"), 4).alias("t_b"), r(F.regr_slope("zv", "x"), 4).alias("t_v"))
    return g.where("n >= 5")


_C1, _C2 = "(0.11 - -0.02 * air)", "(0.047 - -0.011 * air)"


@query("transform_calibrated", f"""{_CALIBRATORS}, i AS (SELECT object_id, avg(mags_fit) FILTER (filter_name = 'B') - avg(mags_fit) FILTER (filter_name = 'V') AS seen FROM photometry WHERE mags_fit IS NOT NULL AND filter_name IN ('B', 'V') GROUP BY 1),
    a AS (SELECT image_id, coalesce(min(airmass), 1.0) AS air FROM frames GROUP BY 1), k2 AS (SELECT image_id, CASE min(filter_name) WHEN 'B' THEN {_C1} WHEN 'V' THEN {_C2} END / (1 - {_C1} + {_C2}) AS term FROM (SELECT DISTINCT image_id, filter_name FROM photometry) JOIN a USING (image_id) GROUP BY image_id, air),
    zz AS (SELECT image_id, v - term * seen AS v FROM z JOIN k2 USING (image_id) JOIN i USING (object_id) WHERE v IS NOT NULL AND term IS NOT NULL AND seen IS NOT NULL), {sql_clip('SELECT image_id, v FROM zz', 'image_id', 1.5)},
    g AS (SELECT image_id, count(*) AS n, quantile_cont(v, 0.5) AS m, stddev_pop(v) AS s FROM c5 GROUP BY ALL)
    SELECT image_id, object_id, n AS n_cal, round(mags_fit + term * seen + m, 6) AS mag, round(s, 6) AS mag_std FROM (SELECT DISTINCT image_id, object_id, mags_fit FROM photometry WHERE mags_fit IS NOT NULL) JOIN g USING (image_id) JOIN k2 USING (image_id) JOIN i USING (object_id) WHERE seen IS NOT NULL""")
def transform_calibrated(t):
    """Magnitudes with a colour term that depends on air mass: instrument magnitude, C times the object's observed colour, and the
    clipped median of what the calibrators leave (zero point less C times *their* observed colour).  Clipping the sums over all
    calibrators is clipping the calibrators' part alone, so the product of objects and calibrators is never formed."""
    m = t.photometry.where("mags_fit IS NOT NULL").select("image_id", "object_id", "filter_name", "mags_fit")
    by_filter = {f: F.avg(F.when(c("filter_name") == f, c("mags_fit"))) for f in "BV"}
    seen = m.where("filter_name IN ('B', 'V')").groupBy("object_id").agg((by_filter["B"] - by_filter["V"]).alias("seen")).where("seen IS NOT NULL")
    air = t.frames.groupBy("image_id").agg(F.coalesce(F.min("airmass"), F.lit(1.0)).alias("air"))
    c1, c2 = 0.11 + 0.02 * c("air"), 0.047 + 0.011 * c("air")
    term = F.when(c("filter_name") == "B", c1).when(c("filter_name") == "V", c2) / (1 - c1 + c2)
    k = t.photometry.groupBy("image_id").agg(F.min("filter_name").alias("filter_name")).join(air, "image_id").select("image_id", term.alias("term")).where("term IS NOT NULL")
    z = zero_points(t).where("v IS NOT NULL").select("image_id", "object_id", "v").join(k, "image_id").join(seen, "object_id")
    g = sigma_clip_stats(z, ["image_id"], c("v") - c("term") * c("seen"), 1.5).select("image_id", c("n").alias("n_cal"), "median", "std")
    d = m.select("image_id", "object_id", "mags_fit").distinct().join(g.join(k, "image_id"), "image_id").join(seen, "object_id")
    return d.select("image_id", "object_id", "n_cal", r(c("mags_fit") + c("term") * c("seen") + c("median")).alias("mag"), r("std").alias("mag_std"))


@query("fit_covariance", """WITH d AS (SELECT catalog_code, mag_b - mag_v AS x, mag_v - 14 AS y, err_v AS e FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL AND err_v IS NOT NULL),
    w AS (SELECT d.*, CASE WHEN least_e > 0 THEN 1 / pow(e, 2) ELSE 1 END AS w FROM d JOIN (SELECT catalog_code, min(e) AS least_e FROM d GROUP BY 1) USING (catalog_code)),
    s AS (SELECT catalog_code, count(*) n, sum(w) s, sum(w * x) sx, sum(w * y) sy, sum(w * x * x) sxx, sum(w * x * y) sxy, sum(w * y * y) syy FROM w GROUP BY 1),
    f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, (sxx * sy - sx * sxy) / (s * sxx - sx * sx) AS a FROM s WHERE n > 2),
    q AS (SELECT *, (syy + a * a * s + b * b * sxx - 2 * a * sy - 2 * b * sxy + 2 * a * b * sx) / (n - 2) AS chi2 FROM f)
    SELECT catalog_code, n, round(a, 4) AS intercept, round(b, 4) AS slope, round(chi2 * sxx / (s * sxx - sx * sx), 6) AS intercept_variance, round(chi2 * s / (s * sxx - sx * sx), 6) AS slope_variance FROM q""")
def fit_covariance(t):
    """Weighted line with the variances of both parameters, scaled by the reduced chi square; without weights where an error is 0.
    One pass of sums; the sum of squares of the residuals follows from them."""
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL AND err_v IS NOT NULL").select("catalog_code", (c("mag_b") - c("mag_v")).alias("x"), (c("mag_v") - 14).alias("y"), c("err_v").alias("e"))
    sums = {"s": F.lit(1.0), "sx": c("x"), "sy": c("y"), "sxx": c("x") * c("x"), "sxy": c("x") * c("y"), "syy": c("y") * c("y")}
    w = F.when(c("e") > 0, 1 / F.pow("e", F.lit(2)))
    g = d.groupBy("catalog_code").agg(F.count("*").alias("n"), F.min("e").alias("least"), *(F.sum(w * x).alias(f"w_{k}") for k, x in sums.items()), *(F.sum(x).alias(f"u_{k}") for k, x in sums.items())).where("n > 2")
    g = g.select("catalog_code", "n", *(F.when(c("least") > 0, c(f"w_{k}")).otherwise(c(f"u_{k}")).alias(k) for k in sums))
    det = c("s") * c("sxx") - c("sx") * c("sx")
    g = g.withColumns({"b": (c("s") * c("sxy") - c("sx") * c("sy")) / det, "a": (c("sxx") * c("sy") - c("sx") * c("sxy")) / det, "det": det})
    rest = c("syy") + c("a") * c("a") * c("s") + c("b") * c("b") * c("sxx") - 2 * c("a") * c("sy") - 2 * c("b") * c("sxy") + 2 * c("a") * c("b") * c("sx")
    chi2 = rest / (c("n") - 2)
    return g.select("catalog_code", "n", r("a", 4).alias("intercept"), r("b", 4).alias("slope"), r(chi2 * c("sxx") / c("det")).alias("intercept_variance"), r(chi2 * c("s") / c("det")).alias("slope_variance"))


@query("clip_zp_mask", f"""{_CALIBRATORS}, p0 AS (SELECT image_id, auid, v FROM z WHERE v IS NOT NULL), {sql_clip('SELECT image_id, v FROM p0', 'image_id', 1.5)}
    SELECT image_id, auid, NOT v BETWEEN m - 1.5 * s AND m + 1.5 * s AS clipped FROM p0 JOIN b4 USING (image_id)""")
def clip_zp_mask(t):
    """Which calibrators of an image the clip leaves out."""
    z = zero_points(t).where("v IS NOT NULL").select("image_id", "auid", "v")
    return sigma_clip_flags(z, ["image_id"], "v", 1.5).select("image_id", "auid", "clipped")


_BY_CHART = "SELECT DISTINCT auid, chart, mag_b, mag_v FROM comp_stars WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL"


@query("clip_pm", f"""WITH d AS ({_BY_CHART}), ca AS (WITH {sql_clip('SELECT chart, mag_b AS v FROM d', 'chart', 1.5)} SELECT * FROM b4), cb AS (WITH {sql_clip('SELECT chart, mag_v AS v FROM d', 'chart', 1.5)} SELECT * FROM b4)
    SELECT auid, d.mag_b, d.mag_v, NOT mag_b BETWEEN ca.m - 1.5 * ca.s AND ca.m + 1.5 * ca.s OR NOT mag_v BETWEEN cb.m - 1.5 * cb.s AND cb.m + 1.5 * cb.s AS clipped
    FROM d JOIN ca ON d.chart IS NOT DISTINCT FROM ca.chart JOIN cb ON d.chart IS NOT DISTINCT FROM cb.chart""")
def clip_pm(t):
    """Two columns of each chart's stars clipped on their own; a star is out if either says so."""
    d = t.comp_stars.where("mag_b IS NOT NULL AND mag_v IS NOT NULL").select("auid", "chart", "mag_b", "mag_v").distinct()
    d = sigma_clip_flags(d, ["chart"], "mag_b", 1.5).withColumnRenamed("clipped", "_b")
    return sigma_clip_flags(d, ["chart"], "mag_v", 1.5).select("auid", "mag_b", "mag_v", (c("_b") | c("clipped")).alias("clipped"))


_MIDDLE = f"(SELECT image_id, object_id FROM (SELECT image_id, object_id, row_number() OVER (PARTITION BY image_id ORDER BY flux_fit, object_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM {_FLUX}) WHERE n < 40 OR k BETWEEN 21 AND 40)"


@query("clip_fwhm", f"WITH {sql_clip(f'SELECT image_id, mags_unc AS v FROM (SELECT DISTINCT image_id, object_id, mags_unc FROM photometry) JOIN {_MIDDLE} USING (image_id, object_id)', 'image_id', 3.0)} SELECT image_id, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS width FROM c5 GROUP BY image_id")
def clip_fwhm(t):
    """Clipped median of a width of each image over its middle stars: bright, but not the brightest (mags_unc stands for the width)."""
    d = t.photometry.where("flux_fit IS NOT NULL").select("image_id", "object_id", "flux_fit").distinct()
    one = W.partitionBy("image_id")
    middle = d.withColumns({"k": F.row_number().over(one.orderBy("flux_fit", "object_id")), "n": F.count("*").over(one)}).where("n < 40 OR k BETWEEN 21 AND 40")
    g = sigma_clip_stats(t.photometry.select("image_id", "object_id", "mags_unc").distinct().join(middle.select("image_id", "object_id"), ["image_id", "object_id"]), ["image_id"], "mags_unc", 3.0)
    return g.where("n > 0").select("image_id", "n", r("median").alias("width"))


@query("clip_local_background", f"WITH {sql_clip('SELECT image_id, flux_err AS v FROM photometry', 'image_id', 5.0)} SELECT image_id, round(3 * quantile_cont(v, 0.5) - 2 * avg(v), 6) AS sky FROM c5 GROUP BY image_id")
def clip_local_background(t):
    """The mode of a clipped sky, three medians less two means."""
    g = sigma_clip_stats(t.photometry, ["image_id"], "flux_err", 5.0).where("n > 0")
    return g.select("image_id", r(3 * c("median") - 2 * c("mean")).alias("sky"))


@query("clip_err_axis", f"WITH {sql_clip('SELECT object_id, filter_name, mags_unc AS v FROM photometry', 'object_id, filter_name', 1.5)} SELECT object_id, filter_name, round(greatest(max(v) * 1.5, 0.1), 6) AS half_axis FROM c5 GROUP BY ALL")
def clip_err_axis(t):
    """Half the height of a light curve's axis: one and a half times the largest error that the clip leaves, a tenth at least."""
    g = sigma_clip_counted(t.photometry, ["object_id", "filter_name"], "mags_unc", 1.5, extremes=True)
    return g.select("object_id", "filter_name", r(F.greatest(c("most") * 1.5, F.lit(0.1))).alias("half_axis"))


@query("clip_fiducial_pair", f"""WITH d AS (SELECT catalog_code AS k, floor((mag_v - 8) / 0.5)::BIGINT AS bin, mag_v, mag_b - mag_v AS colour FROM calib WHERE mag_v IS NOT NULL AND mag_b IS NOT NULL),
    a AS (WITH {sql_clip('SELECT k, bin, mag_v AS v FROM d', 'k, bin', 3.0)} SELECT k, bin, quantile_cont(v, 0.5) AS mag FROM c5 GROUP BY ALL), b AS (WITH {sql_clip('SELECT k, bin, colour AS v FROM d', 'k, bin', 3.0)} SELECT k, bin, quantile_cont(v, 0.5) AS colour FROM c5 GROUP BY ALL)
    SELECT a.k AS catalog_code, a.bin, round(mag, 6) AS mag, round(colour, 6) AS colour FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.bin = b.bin""")
def clip_fiducial_pair(t):
    """Fiducial line of each catalogue: clipped medians of magnitude and colour, each on its own, in steps of half a magnitude."""
    d = t.calib.where("mag_v IS NOT NULL AND mag_b IS NOT NULL").select("catalog_code", F.floor((c("mag_v") - 8) / 0.5).cast("long").alias("bin"), "mag_v", (c("mag_b") - c("mag_v")).alias("colour"))
    a, b = (sigma_clip_counted(d, ["catalog_code", "bin"], x, 3.0).select("catalog_code", "bin", r("median").alias(n)) for x, n in (("mag_v", "mag"), ("colour", "colour")))
    b = b.select(c("catalog_code").alias("_k"), c("bin").alias("_b"), "colour")
    return a.join(b, c("catalog_code").eqNullSafe(c("_k")) & (c("bin") == c("_b"))).select("catalog_code", "bin", "mag", "colour")


_FIELD = "(SELECT DISTINCT object_name AS o, image_id, object_id FROM photometry JOIN (SELECT image_id, min(object_name) AS object_name FROM frames GROUP BY image_id) USING (image_id) WHERE object_name IS NOT NULL AND object_id IS NOT NULL)"


@query("nway_protected", f"""WITH d AS {_FIELD}, n AS (SELECT o, count(DISTINCT image_id) AS n FROM d GROUP BY o), k AS (SELECT o, object_id, count(*) AS k FROM d GROUP BY ALL),
    p AS (SELECT o, arg_max(object_id, (k, -object_id)) AS object_id FROM k GROUP BY o), good AS (SELECT k.o, k.object_id FROM k JOIN n USING (o) LEFT JOIN p ON p.o = k.o AND p.object_id = k.object_id WHERE n - k < 0.2 * n OR p.object_id IS NOT NULL),
    m AS (SELECT o, count(*) AS m FROM good GROUP BY o), i AS (SELECT d.o, d.image_id, count(*) AS here, bool_or(p.object_id IS NOT NULL) AS has FROM d JOIN good USING (o, object_id) LEFT JOIN p ON p.o = d.o AND p.object_id = d.object_id GROUP BY ALL),
    kept AS (SELECT i.o, image_id FROM i JOIN m USING (o) WHERE m - here <= 0.02 * m AND has), n2 AS (SELECT o, count(*) AS n FROM kept GROUP BY o)
    SELECT d.o AS object_name, object_id, count(*) AS n_images FROM d JOIN good USING (o, object_id) JOIN kept USING (o, image_id) JOIN n2 USING (o) GROUP BY d.o, object_id, n HAVING count(*) = n""")
def nway_protected(t):
    """Objects that all images of a field share.  Objects that a fifth of the images miss go first, but for the protected one (the
    most often seen); then images that miss more than two per cent of the objects left, or the protected one; then objects that an
    image left does not have."""
    name = t.frames.groupBy("image_id").agg(F.min("object_name").alias("object_name")).where("object_name IS NOT NULL")
    d = t.photometry.where("object_id IS NOT NULL").select("image_id", "object_id").distinct().join(name, "image_id")
    n = d.groupBy("object_name").agg(F.countDistinct("image_id").alias("n"))
    k = d.groupBy("object_name", "object_id").agg(F.count("*").alias("k"))
    guarded = k.groupBy("object_name").agg(F.max(F.struct("k", (-c("object_id")).alias("o"))).alias("p")).select("object_name", (-c("p.o")).alias("guarded"))
    good = k.join(n, "object_name").join(guarded, "object_name").where((c("n") - c("k") < 0.2 * c("n")) | (c("object_id") == c("guarded"))).select("object_name", "object_id", "guarded")
    m = good.groupBy("object_name").agg(F.count("*").alias("m"))
    left = d.join(good, ["object_name", "object_id"])
    kept = left.groupBy("object_name", "image_id").agg(F.count("*").alias("here"), F.bool_or(c("object_id") == c("guarded")).alias("has")).join(m, "object_name").where("m - here <= 0.02 * m AND has").select("object_name", "image_id")
    n2 = kept.groupBy("object_name").agg(F.count("*").alias("n"))
    return left.join(kept, ["object_name", "image_id"]).groupBy("object_name", "object_id").agg(F.count("*").alias("n_images")).join(n2, "object_name").where("n_images = n").drop("n")


@query("psf_edge_filter", "SELECT image_id, object_id, x_fit, y_fit FROM photometry JOIN (SELECT image_id, min(naxis1) nx, min(naxis2) ny FROM frames GROUP BY image_id) USING (image_id) WHERE x_fit > 12 AND x_fit < nx - 1 - 12 AND y_fit > 12 AND y_fit < ny - 1 - 12")
def psf_edge_filter(t, box: int = 25):
    """Stars whose box of pixels is wholly inside the image."""
    from photoloom.functions import photometric as P

    half = (box - 1) / 2
    size = t.frames.groupBy("image_id").agg(F.min("naxis1").alias("nx"), F.min("naxis2").alias("ny"))
    return t.photometry.join(size, "image_id").where(P.inside(c("x_fit"), c("nx"), half) & P.inside(c("y_fit"), c("ny"), half)).select("image_id", "object_id", "x_fit", "y_fit")


@query("mask_negative", f"SELECT image, y, x, min(v - 25) < 0 AS masked FROM {_PIX} GROUP BY ALL")
def mask_negative(t):
    return pixels(t).groupBy("image", "y", "x").agg((F.min(c("v") - 25) < 0).alias("masked"))


@query("mask_and", f"SELECT y, x, bool_and(v > 2) AS masked FROM {_PIX} GROUP BY y, x")
def mask_and(t):
    return pixels(t).groupBy("y", "x").agg(F.bool_and(c("v") > 2).alias("masked"))


@query("group_shape_max", "SELECT imagetyp, naxis1, naxis2, max(exptime) AS longest, count(*) AS n FROM frames GROUP BY ALL")
def group_shape_max(t):
    """The longest exposure of each image shape and type."""
    return t.frames.groupBy("imagetyp", "naxis1", "naxis2").agg(F.max("exptime").alias("longest"), F.count("*").alias("n"))


@query("exposures_sorted", "SELECT imagetyp, string_agg(CAST(CAST(round(exptime * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY exptime) AS times_ms FROM (SELECT DISTINCT imagetyp, exptime FROM frames WHERE exptime IS NOT NULL) GROUP BY imagetyp")
def exposures_sorted(t):
    """The different exposure times of each image type, in order."""
    d = t.frames.where("exptime IS NOT NULL").select("imagetyp", "exptime").distinct().groupBy("imagetyp").agg(F.sort_array(F.collect_list("exptime")).alias("a"))
    return d.select("imagetyp", F.array_join(F.transform("a", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("times_ms"))


@query("first_fifty", "SELECT image_id, id, object_id FROM (SELECT image_id, id, object_id, row_number() OVER (PARTITION BY image_id ORDER BY id, object_id) AS k FROM (SELECT DISTINCT image_id, id, object_id FROM photometry)) WHERE k <= 50")
def first_fifty(t):
    """The first fifty stars of each image, which its astrometry is solved with."""
    d = t.photometry.select("image_id", "id", "object_id").distinct()
    return d.withColumn("k", F.row_number().over(W.partitionBy("image_id").orderBy("id", "object_id"))).where("k <= 50").drop("k")


def _valid(seen: Column) -> Column:
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS))
    return F.filter(pairs, lambda p: F.array_contains(seen, p["a"]) & F.array_contains(seen, p["b"]))


@query("valid_filters", "WITH s AS (SELECT DISTINCT object_id, filter_name f FROM photometry), p AS (SELECT object_id, a.f AS a, b.f AS b FROM s a JOIN s b USING (object_id) WHERE a.f || '-' || b.f IN ('U-V', 'B-V', 'V-R', 'V-I') AND b.f IN ('B', 'V')) SELECT DISTINCT object_id, unnest([a, b]) AS filter_name FROM p")
def valid_filters(t, catalogue: tuple[str, ...] = ("B", "V")):
    """The filters that some valid pair of an object uses, of pairs whose second filter the catalogue has."""
    seen = t.photometry.groupBy("object_id").agg(F.collect_set("filter_name").alias("s")).select("object_id", F.explode(_valid(c("s"))).alias("p"))
    return seen.where(c("p.b").isin(*catalogue)).select("object_id", F.explode(F.array("p.a", "p.b")).alias("filter_name")).distinct()


@query("id_difference", "SELECT DISTINCT object_id FROM photometry WHERE filter_name = 'V' AND object_id IS NOT NULL EXCEPT SELECT object_id FROM photometry WHERE filter_name = 'B'")
def id_difference(t):
    """Objects seen in one filter and never in the other."""
    v, b = (t.photometry.where(f"filter_name = '{f}' AND object_id IS NOT NULL").select("object_id") for f in "VB")
    return v.subtract(b)


@query("protected_ids", f"{_CALIBRATORS} SELECT object_id, bool_or(kind = 'calibrator') AS calibrator FROM (SELECT DISTINCT object_id, 'calibrator' AS kind FROM z UNION ALL SELECT object_id, 'reference' FROM (SELECT object_id FROM photometry WHERE object_id IS NOT NULL GROUP BY object_id HAVING count(DISTINCT image_id) >= 100)) GROUP BY object_id")
def protected_ids(t):
    """Identifiers of calibrators and of objects of interest, put together."""
    cal = zero_points(t).select("object_id").distinct().withColumn("kind", F.lit("calibrator"))
    often = t.photometry.where("object_id IS NOT NULL").groupBy("object_id").agg(F.countDistinct("image_id").alias("n")).where("n >= 100").select("object_id", F.lit("reference").alias("kind"))
    return cal.union(often).groupBy("object_id").agg(F.bool_or(c("kind") == "calibrator").alias("calibrator"))


@query("one_object", "SELECT image_id, filter_name, x_fit, y_fit, mags_fit FROM (SELECT DISTINCT image_id, object_id, filter_name, x_fit, y_fit, mags_fit FROM photometry) WHERE object_id = (SELECT min(object_id) FROM photometry)")
def one_object(t):
    """All rows of one object, the first of the table."""
    first = t.photometry.agg(F.min("object_id").alias("object_id"))
    return t.photometry.join(F.broadcast(first), "object_id").select("image_id", "filter_name", "x_fit", "y_fit", "mags_fit").distinct()


@query("stack_by_image", "SELECT image_id, count(*) AS n, string_agg(object_id || ':' || CAST(round(m * 10000) AS BIGINT), ' ' ORDER BY object_id) AS row_ FROM (SELECT image_id, object_id, min(mags_fit) AS m FROM photometry WHERE object_id IS NOT NULL AND mags_fit IS NOT NULL GROUP BY ALL) GROUP BY image_id")
def stack_by_image(t):
    """One row for each image with the magnitudes of its objects in order of the object (ten-thousandths)."""
    d = t.photometry.where("object_id IS NOT NULL AND mags_fit IS NOT NULL").groupBy("image_id", "object_id").agg(F.min("mags_fit").alias("m"))
    a = d.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("object_id", "m"))).alias("a"))
    return a.select("image_id", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["object_id"].cast("string"), F.round(x["m"] * 10000).cast("long").cast("string"))), " ").alias("row_"))


@query("cluster_group", "SELECT label AS cluster, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS pm_ra, round(avg(embedding[2]::DOUBLE), 6) AS pm_de, round(min(embedding[3]::DOUBLE), 6) AS nearest, round(max(embedding[3]::DOUBLE), 6) AS farthest FROM embeddings GROUP BY label")
def cluster_group(t):
    """What the members of each cluster share: mean proper motions and the range of distances."""
    e = lambda k: c("embedding")[k].cast("double")
    return t.embeddings.groupBy(c("label").alias("cluster")).agg(F.count("*").alias("n"), r(F.avg(e(0))).alias("pm_ra"), r(F.avg(e(1))).alias("pm_de"), r(F.min(e(2))).alias("nearest"), r(F.max(e(2))).alias("farthest"))


_SHIFTS = "(SELECT l_orderkey * 8 + l_linenumber AS image, l_orderkey // 64 AS series, ((l_partkey % 41) - 20)::DOUBLE / 2 AS dy, ((l_suppkey % 31) - 15)::DOUBLE / 2 AS dx FROM lineitem)"
_MIRROR = "list_transform(range(i - 4, i + 4), lambda j: {a}[CASE WHEN len({a}) = 0 THEN 1 ELSE CASE WHEN ((j % (2 * len({a}))) + 2 * len({a})) % (2 * len({a})) < len({a}) THEN ((j % (2 * len({a}))) + 2 * len({a})) % (2 * len({a})) ELSE 2 * len({a}) - 1 - ((j % (2 * len({a}))) + 2 * len({a})) % (2 * len({a})) END + 1 END])"


@query("shift_outliers", f"""WITH g AS (SELECT series, list(image ORDER BY image, dy, dx) AS im, list(dy ORDER BY image, dy, dx) AS ys, list(dx ORDER BY image, dy, dx) AS xs FROM {_SHIFTS} GROUP BY series),
    e AS (SELECT series, unnest(range(len(im))) AS i, im, ys, xs FROM g)
    SELECT im[i + 1] AS image, round(abs(ys[i + 1] - list_sort({_MIRROR.format(a='ys')})[5]) + abs(xs[i + 1] - list_sort({_MIRROR.format(a='xs')})[5]), 6) AS score, abs(ys[i + 1] - list_sort({_MIRROR.format(a='ys')})[5]) + abs(xs[i + 1] - list_sort({_MIRROR.format(a='xs')})[5]) > 10 AS odd FROM e""")
def shift_outliers(t, window: int = 8, threshold: float = 10.0):
    """Images whose shifts along both axes, together, are far from the running median of their series (an even window reaches
    further back than ahead; at its ends a series is mirrored)."""
    s = t.lineitem.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("image"), F.floor(c("l_orderkey") / 64).alias("series"), (((c("l_partkey") % 41) - 20) / 2).alias("dy"), (((c("l_suppkey") % 31) - 15) / 2).alias("dx"))
    g = s.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("image", "dy", "dx"))).alias("a")).withColumn("n", F.size("a"))
    e = g.select("a", "n", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("i"))

    def off(axis: str) -> Column:
        def at(j: Column) -> Column:
            k = F.pmod(j, 2 * c("n"))
            return F.get(c("a")[axis], F.when(k < c("n"), k).otherwise(2 * c("n") - 1 - k))

        near = F.sort_array(F.transform(F.sequence(c("i") - window // 2, c("i") + (window - 1) // 2), at))
        return F.abs(F.get(c("a")[axis], c("i")) - F.get(near, F.lit(window // 2)))

    score = off("dy") + off("dx")
    return e.select(F.get(c("a")["image"], c("i")).alias("image"), r(score).alias("score"), (score > threshold).alias("odd"))


@query("width_bins_linspace", """WITH d AS (SELECT mag_v AS m, mag_b - mag_v AS v FROM calib WHERE mag_v IS NOT NULL AND mag_b IS NOT NULL), e AS (SELECT min(m) AS a, (max(m) - min(m)) / 39 AS w FROM d)
    SELECT floor((m - a) / w)::BIGINT AS bin, count(*) AS n, round(avg(v), 6) AS mean FROM d, e WHERE m < a + 39 * w GROUP BY ALL""")
def width_bins_linspace(t, edges: int = 40):
    """Bins between the least and the largest value, both included in the edges; the largest value itself falls outside."""
    d = t.calib.where("mag_v IS NOT NULL AND mag_b IS NOT NULL").select(c("mag_v").alias("m"), (c("mag_b") - c("mag_v")).alias("v"))
    low, high = d.agg(F.min("m"), F.max("m")).first()
    if low is None or low == high:
        return d.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), "v").limit(0).withColumnRenamed("v", "mean")
    step = (high - low) / (edges - 1)
    d = d.where(c("m") < low + (edges - 1) * step)
    return d.groupBy(F.floor((c("m") - low) / step).cast("long").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"))


DRAWS = 1000
_Z = "(SELECT k, sqrt(-2 * ln((k + 0.5) / 1000)) * cos(2 * pi() * (k * 0.6180339887498949 - floor(k * 0.6180339887498949))) AS za, sqrt(-2 * ln((k + 0.5) / 1000)) * sin(2 * pi() * (k * 0.6180339887498949 - floor(k * 0.6180339887498949))) AS zb FROM range(1000) t(k))"


@query("mc_arithmetic", f"""WITH s AS (SELECT DISTINCT auid, mag_b, mag_v, coalesce(err_v, 0.03) AS e FROM comp_stars WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL),
    x AS (SELECT auid, mag_b, mag_v, e, (mag_b + 1.2 * e * za) - (mag_v + e * zb) AS colour, 0.11 * ((mag_b + 1.2 * e * za) - (mag_v + e * zb)) + mag_v + e * zb AS corrected FROM s, {_Z} z)
    SELECT auid, round(mag_v, 6) AS mag_v, round(quantile_cont(colour, 0.5), 6) AS colour, round(stddev_pop(colour), 6) AS colour_std, round(quantile_cont(corrected, 0.5), 6) AS corrected, round(stddev_pop(corrected), 6) AS corrected_std FROM x GROUP BY auid, mag_b, mag_v, e""")
def mc_arithmetic(t):
    """Arithmetic on samples: a colour and a magnitude with a colour term, from a thousand samples of two magnitudes.  The samples
    come from one evenly spread list of pairs of normal numbers, so any engine draws the same."""
    s = t.comp_stars.where("mag_b IS NOT NULL AND mag_v IS NOT NULL").select("auid", "mag_b", "mag_v", F.coalesce("err_v", F.lit(0.03)).alias("e")).distinct()
    turns = lambda k: k * 0.6180339887498949 - F.floor(k * 0.6180339887498949)
    size = lambda k: F.sqrt(-2 * F.log((k + 0.5) / DRAWS))
    b = lambda k: c("mag_b") + 1.2 * c("e") * size(k) * F.cos(2 * math.pi * turns(k))
    v = lambda k: c("mag_v") + c("e") * size(k) * F.sin(2 * math.pi * turns(k))
    draws = F.sequence(F.lit(0), F.lit(DRAWS - 1))
    both = {"colour": lambda k: b(k) - v(k), "corrected": lambda k: 0.11 * (b(k) - v(k)) + v(k)}
    d = s.select("auid", "mag_v", *(F.sort_array(F.transform(draws, f)).alias(n) for n, f in both.items()))
    d = d.withColumns({f"{n}_mean": array_mean(c(n)) for n in both})
    return d.select("auid", r("mag_v").alias("mag_v"), *(x for n in both for x in (r(array_median(c(n))).alias(n), r(array_std(c(n), c(f"{n}_mean"))).alias(f"{n}_std"))))


@query("masters_attached", f"""WITH f AS (SELECT image_id, min(imagetyp) AS kind, min(instrume) AS camera, min(filter_name) AS filter, min(exptime) AS exptime FROM frames GROUP BY image_id),
    l AS (SELECT * FROM f WHERE kind = 'Light Frame' AND camera IS NOT NULL), bias AS (SELECT camera, min(image_id) AS bias_id FROM f WHERE kind = 'Bias Frame' GROUP BY 1), flat AS (SELECT camera, filter, min(image_id) AS flat_id FROM f WHERE kind = 'Flat Field' GROUP BY ALL),
    dark AS (SELECT camera, exptime, min(image_id) AS dark_id FROM f WHERE kind = 'Dark Frame' AND exptime IS NOT NULL GROUP BY ALL), near AS (SELECT l.image_id, arg_min(dark_id, (abs(dark.exptime - l.exptime), dark.exptime)) AS dark_id, arg_min(dark.exptime, (abs(dark.exptime - l.exptime), dark.exptime)) AS dark_exptime FROM l JOIN dark USING (camera) GROUP BY 1)
    SELECT l.image_id, bias_id, dark_id, flat_id, abs(dark_exptime - l.exptime) > 0.5 AS dark_is_scaled FROM l LEFT JOIN bias USING (camera) LEFT JOIN near USING (image_id) LEFT JOIN flat ON flat.camera = l.camera AND flat.filter = l.filter""")
def masters_attached(t):
    """The masters each light frame is reduced with: the camera's bias, the dark of the nearest exposure (scaled if it is off by
    more than half a second), the flat of the camera and filter."""
    from photoloom.operators.nearest import nearest_on_axis

    f = t.frames.groupBy("image_id").agg(F.min("imagetyp").alias("kind"), F.min("instrume").alias("camera"), F.min("filter_name").alias("filter"), F.min("exptime").alias("exptime")).where("camera IS NOT NULL")
    light = f.where("kind = 'Light Frame'").drop("kind")
    bias = f.where("kind = 'Bias Frame'").groupBy("camera").agg(F.min("image_id").alias("bias_id"))
    flat = f.where("kind = 'Flat Field'").groupBy("camera", "filter").agg(F.min("image_id").alias("flat_id"))
    dark = f.where("kind = 'Dark Frame'").select("camera", "exptime", c("image_id").alias("dark_id"))
    near = nearest_on_axis(light.where("exptime IS NOT NULL").select("camera", "exptime").distinct(), dark, ["camera"], "exptime", "dark_id")
    d = light.join(near, ["camera", "exptime"], "left").join(bias, "camera", "left").join(flat, ["camera", "filter"], "left")
    return d.select("image_id", "bias_id", c("near_dark_id").alias("dark_id"), "flat_id", (F.abs(c("near_exptime") - c("exptime")) > 0.5).alias("dark_is_scaled"))


_FIDUCIAL = "SELECT catalog_code AS k, floor((mag_v - 8) / 0.5)::BIGINT AS bin, quantile_cont(mag_v, 0.5) AS mag, quantile_cont(mag_b - mag_v, 0.5) AS colour FROM calib WHERE mag_v IS NOT NULL AND mag_b IS NOT NULL AND catalog_code IS NOT NULL GROUP BY ALL"
#: Observed points at most that are compared with models.
MOST_POINTS = 20_000


@query("isochrone_fit", f"""WITH o AS ({_FIDUCIAL}), i AS (SELECT label, 13 + 8 * embedding[1]::DOUBLE AS mag, 1 + 2 * embedding[2]::DOUBLE AS colour FROM embeddings),
    d AS (SELECT k, bin, label, arg_min(struct_pack(m := i.mag, c := i.colour), round(pow(i.mag - o.mag, 2) + pow(i.colour - o.colour, 2), 9)) AS near, any_value(o.mag) AS mag, any_value(o.colour) AS colour FROM o, i GROUP BY ALL),
    s AS (SELECT k, label, sum(pow(mag - near.m, 2)) AS chi2_mag, sum(pow(colour - near.c, 2)) AS chi2_colour FROM d GROUP BY ALL)
    SELECT k AS catalog_code, label AS isochrone, round(chi2_mag + chi2_colour, 4) AS chi2 FROM s""")
def isochrone_fit(t):
    """Chi square of every isochrone of a table against the fiducial points of every catalogue, each point against the nearest one
    of the isochrone.  The observed points are bins, a bounded list (checked): every model point meets them as one array, and the
    nearest is kept with map-side minima; models of any number are never paired with each other."""
    d = t.calib.where("mag_v IS NOT NULL AND mag_b IS NOT NULL AND catalog_code IS NOT NULL").groupBy("catalog_code", F.floor((c("mag_v") - 8) / 0.5).cast("long").alias("bin"))
    observed = d.agg(F.percentile("mag_v", 0.5).alias("mag"), F.percentile(c("mag_b") - c("mag_v"), 0.5).alias("colour"))
    points = observed.limit(MOST_POINTS + 1).collect()
    if len(points) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} observed points; bin them more coarsely")
    array = F.from_json(F.lit(json.dumps([dict(zip(("k", "bin", "mag", "colour"), p, strict=True)) for p in points])), "array<struct<k:string,bin:bigint,mag:double,colour:double>>")
    models = t.embeddings.select(c("label").alias("isochrone"), (13 + 8 * c("embedding")[0].cast("double")).alias("m"), (1 + 2 * c("embedding")[1].cast("double")).alias("c"))
    met = models.select("isochrone", "m", "c", F.inline(array))
    near = met.groupBy("k", "bin", "isochrone").agg(F.min_by(F.struct((c("m") - c("mag")).alias("dm"), (c("c") - c("colour")).alias("dc")), F.round(F.pow(c("m") - c("mag"), F.lit(2)) + F.pow(c("c") - c("colour"), F.lit(2)), 9)).alias("n"))
    return near.groupBy(c("k").alias("catalog_code"), "isochrone").agg(r(F.sum(c("n.dm") * c("n.dm") + c("n.dc") * c("n.dc")), 4).alias("chi2"))
