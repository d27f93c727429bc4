"""Column operators: fluxes and magnitudes, geometry, time, filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoloom.functions import photometric as P
from photoloom.functions.sky import pixel_to_sky, sky_to_pixel
from photoloom.operators.quantiles import exact_median
from photoloom.operators.spatial import separation_arcsec
from photoloom.operators.spikes import image_times
from photoloom.plans.registry import Registry, Tables, r, sql_values

query = Registry()
c = F.col

WCS = "(SELECT image_id, min(crpix1) crpix1, min(crpix2) crpix2, min(crval1) crval1, min(crval2) crval2, min(cd11) cd11, min(cd12) cd12, min(cd21) cd21, min(cd22) cd22 FROM wcs GROUP BY image_id)"
#: image_id, f, o, jd of each image.
SQL_TIMES = "(SELECT image_id, min(filter_name) AS f, min(object_name) AS o, coalesce(min(jd), min(epoch_us(date_obs) / 86400e6 + 2440587.5)) AS jd FROM frames GROUP BY image_id)"
WCS_COLUMNS = ["crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22"]


def solutions(t: Tables) -> DataFrame:
    return t.wcs.groupBy("image_id").agg(*(F.min(x).alias(x) for x in WCS_COLUMNS))


def sql_sky(x: str, y: str) -> tuple[str, str]:
    """SQL of a pixel's right ascension and declination, given the columns of a solution."""
    xi = f"radians(cd11 * ({x} + 1 - crpix1) + cd12 * ({y} + 1 - crpix2))"
    eta = f"radians(cd21 * ({x} + 1 - crpix1) + cd22 * ({y} + 1 - crpix2))"
    d0 = "radians(crval2)"
    across, along = f"(cos({d0}) - {eta} * sin({d0}))", f"(sin({d0}) + {eta} * cos({d0}))"
    ra = f"(crval1 + degrees(atan2({xi}, {across})))"
    return f"({ra} - 360 * floor({ra} / 360))", f"degrees(atan2({along}, sqrt(pow({xi}, 2) + pow({across}, 2))))"


def sql_separation(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    return f"(2 * asin(sqrt(least(1.0, pow(sin(radians({dec2} - {dec1}) / 2), 2) + cos(radians({dec1})) * cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2)))) * {180 * 3600 / math.pi!r})"


@query("flux_to_mag", "SELECT image_id, object_id, round(CASE WHEN flux_fit > 0 THEN -2.5 * log10(flux_fit) END, 6) AS mag, round(CASE WHEN flux_fit > 0 THEN 2.5 / ln(10) * flux_err / flux_fit END, 6) AS mag_err, round(CASE WHEN flux_fit > 0 THEN -2.5 * flux_err / flux_fit END, 6) AS mag_err_linear FROM photometry")
def flux_to_mag(t):
    return t.photometry.select("image_id", "object_id", r(P.magnitude(c("flux_fit"))).alias("mag"), r(P.magnitude_error(c("flux_fit"), c("flux_err"))).alias("mag_err"), r(F.when(c("flux_fit") > 0, -2.5 * c("flux_err") / c("flux_fit"))).alias("mag_err_linear"))


@query("err_prop", "SELECT image_id, object_id, round(sqrt(pow(mags_unc, 2) + pow(0.02, 2) + pow(0.001 * id, 2)), 6) AS err FROM photometry")
def err_prop(t):
    return t.photometry.select("image_id", "object_id", r(P.quadrature(c("mags_unc"), F.lit(0.02), 0.001 * c("id"))).alias("err"))


@query("aperture_err", "SELECT image_id, object_id, round(sqrt(pow(flux_err, 2) / gain + 78.5 * pow(3.2, 2) * (1 + 78.5 / 235.6)), 6) AS err FROM photometry JOIN (SELECT image_id, min(gain) AS gain FROM frames GROUP BY image_id) USING (image_id) WHERE gain > 0")
def aperture_err(t):
    gain = t.frames.groupBy("image_id").agg(F.min("gain").alias("gain")).where("gain > 0")
    return t.photometry.join(gain, "image_id").select("image_id", "object_id", r(P.aperture_error(F.pow("flux_err", F.lit(2)), c("gain"), 78.5, 235.6, F.lit(3.2))).alias("err"))


@query("aperture_bkg_sub", "SELECT image_id, object_id, round(flux_fit - (flux_err * 40) * 78.5 / 235.6, 6) AS flux FROM photometry")
def aperture_bkg_sub(t):
    return t.photometry.select("image_id", "object_id", r(P.without_background(c("flux_fit"), c("flux_err") * 40, 78.5, 235.6)).alias("flux"))


_CHIP = "(naxis1 * pixel_um / 1000 / coalesce(focal_mm, 3454.0))"


@query("fov_pixel_scale", f"SELECT image_id, round(2 * atan({_CHIP} / 2) * 180 / pi() * 60, 6) AS fov_arcmin, round(2 * atan({_CHIP} / 2) * 180 / pi() * 3600 / naxis1, 6) AS scale_arcsec, round(5.0 / (2 * atan({_CHIP} / 2) * 180 / pi() * 3600 / naxis1), 6) AS radius_px FROM frames")
def fov_pixel_scale(t):
    fov = P.field_of_view_arcmin(c("naxis1"), c("pixel_um"), c("focal_mm"))
    return t.frames.select("image_id", r(fov).alias("fov_arcmin"), r(fov * 60 / c("naxis1")).alias("scale_arcsec"), r(5.0 / (fov * 60 / c("naxis1"))).alias("radius_px"))


@query("edge_filter", "SELECT image_id, object_id, x_fit, y_fit FROM photometry JOIN (SELECT image_id, min(naxis1) nx, min(naxis2) ny FROM frames GROUP BY image_id) USING (image_id) WHERE x_fit > 41 AND x_fit < nx - 1 - 41 AND y_fit > 41 AND y_fit < ny - 1 - 41")
def edge_filter(t):
    size = t.frames.groupBy("image_id").agg(F.min("naxis1").alias("nx"), F.min("naxis2").alias("ny"))
    return t.photometry.join(size, "image_id").where(P.inside(c("x_fit"), c("nx"), 41) & P.inside(c("y_fit"), c("ny"), 41)).select("image_id", "object_id", "x_fit", "y_fit")


@query("psf_clean", "SELECT image_id, object_id, flux_fit, flux_err FROM photometry WHERE flux_err IS NOT NULL AND flux_fit >= 0 AND flux_err >= 0 AND x_fit >= 0 AND y_fit >= 0")
def psf_clean(t):
    keep = c("flux_err").isNotNull() & ~F.isnan("flux_err")
    for x in ("flux_fit", "flux_err", "x_fit", "y_fit"):
        keep = keep & (c(x) >= 0)
    return t.photometry.where(keep).select("image_id", "object_id", "flux_fit", "flux_err")


@query("flux_positive", "SELECT image_id, object_id, flux_fit FROM photometry WHERE flux_fit > 0")
def flux_positive(t):
    return t.photometry.where("flux_fit > 0").select("image_id", "object_id", "flux_fit")


@query("mag_range", "SELECT cal_id, coalesce(mag_v, mag_r, mag_b, mag_i, mag_u) AS mag FROM calib WHERE coalesce(mag_v, mag_r, mag_b, mag_i, mag_u) BETWEEN 12.0 AND 15.5")
def mag_range(t):
    best = F.coalesce(*(f"mag_{b}" for b in "vrbiu"))
    return t.calib.where(best.between(12.0, 15.5)).select("cal_id", best.alias("mag"))


@query("mag_plausible", "SELECT image_id, object_id, mag_cali_trans FROM photometry WHERE mag_cali_trans < 30")
def mag_plausible(t):
    return t.photometry.where("mag_cali_trans < 30").select("image_id", "object_id", "mag_cali_trans")


@query("drop_masked", "SELECT cal_id, mag_v, mag_b FROM calib WHERE mag_v IS NOT NULL AND err_v IS NOT NULL AND mag_b IS NOT NULL AND err_b IS NOT NULL")
def drop_masked(t):
    return t.calib.dropna(subset=["mag_v", "err_v", "mag_b", "err_b"]).select("cal_id", "mag_v", "mag_b")


@query("quality_flags", "SELECT image_id, file_name FROM frames WHERE combined IS NOT NULL AND NOT combined AND enlarged IS NOT NULL AND NOT enlarged")
def quality_flags(t):
    return t.frames.where("combined IS NOT NULL AND NOT combined AND enlarged IS NOT NULL AND NOT enlarged").select("image_id", "file_name")


@query("filter_frames", "SELECT image_id, file_name, exptime FROM frames WHERE imagetyp = 'Light Frame' AND filter_name = 'V' AND NOT combined AND exptime = 45.0")
def filter_frames(t):
    return t.frames.where("imagetyp = 'Light Frame' AND filter_name = 'V' AND NOT combined AND exptime = 45.0").select("image_id", "file_name", "exptime")


@query("pix_sky", f"SELECT image_id, object_id, round({sql_sky('x_fit', 'y_fit')[0]}, 6) AS ra, round({sql_sky('x_fit', 'y_fit')[1]}, 6) AS dec FROM photometry JOIN {WCS} w USING (image_id) WHERE x_fit IS NOT NULL AND y_fit IS NOT NULL")
def pix_sky(t):
    d = t.photometry.where("x_fit IS NOT NULL AND y_fit IS NOT NULL").join(solutions(t), "image_id")
    ra, dec = pixel_to_sky(c("x_fit"), c("y_fit"), {x: c(x) for x in WCS_COLUMNS})
    return d.select("image_id", "object_id", r(ra).alias("ra"), r(dec).alias("dec"))


@query("sky_pix", "SELECT image_id, object_id, round(x_fit, 4) AS x, round(y_fit, 4) AS y FROM photometry JOIN (SELECT DISTINCT image_id FROM wcs) w USING (image_id) WHERE x_fit IS NOT NULL AND y_fit IS NOT NULL")
def sky_pix(t):
    w = {x: c(x) for x in WCS_COLUMNS}
    d = t.photometry.where("x_fit IS NOT NULL AND y_fit IS NOT NULL").join(solutions(t), "image_id")
    ra, dec = pixel_to_sky(c("x_fit"), c("y_fit"), w)
    d = d.withColumns({"_ra": ra, "_dec": dec})
    x, y = sky_to_pixel(c("_ra"), c("_dec"), w)
    return d.select("image_id", "object_id", r(x, 4).alias("x"), r(y, 4).alias("y"))


TRANSFORMS = [(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 0.999, -0.02, 3.5, 0.02, 0.999, -2.25), (2, -1.0, 0.001, 2999.0, -0.001, -1.0, 1999.0)]


@query("sim_transform", f"""SELECT image_id, object_id, round((a22 * (x_fit - a13) - a12 * (y_fit - a23)) / (a11 * a22 - a12 * a21), 6) AS x, round((a11 * (y_fit - a23) - a21 * (x_fit - a13)) / (a11 * a22 - a12 * a21), 6) AS y
    FROM photometry JOIN {sql_values(TRANSFORMS, "k, a11, a12, a13, a21, a22, a23")} ON image_id % 3 = k""")
def sim_transform(t):
    m = t.values(TRANSFORMS, "k int, a11 double, a12 double, a13 double, a21 double, a22 double, a23 double")
    d = t.photometry.join(m, c("image_id") % 3 == c("k"))
    x, y = P.inverse_affine(c("x_fit"), c("y_fit"), [c(f"a{i}{j}") for i in (1, 2) for j in (1, 2, 3)])
    return d.select("image_id", "object_id", r(x).alias("x"), r(y).alias("y"))


@query("catalog_arithmetic", "SELECT cal_id, round((mag_b - mag_v) + mag_v, 6) AS b, round(mag_b - mag_v, 6) AS b_v, round(sqrt(pow(err_b, 2) + pow(err_v, 2)), 6) AS err_b_v, round(err_b + err_v, 6) AS err_linear FROM calib")
def catalog_arithmetic(t):
    return t.calib.select("cal_id", r((c("mag_b") - c("mag_v")) + c("mag_v")).alias("b"), r(c("mag_b") - c("mag_v")).alias("b_v"), r(P.quadrature(c("err_b"), c("err_v"))).alias("err_b_v"), r(c("err_b") + c("err_v")).alias("err_linear"))


@query("region_filter", f"SELECT DISTINCT auid, name FROM comp_stars k JOIN targets g ON {sql_separation('g.ra_deg', 'g.dec_deg', 'k.ra_deg', 'k.dec_deg')} <= 600")
def region_filter(t):
    from photoloom.operators.spatial import sky_pairs

    return sky_pairs(t.comp_stars.select("auid", "ra_deg", "dec_deg"), t.targets.select("name", "ra_deg", "dec_deg"), 600).select("l.auid", "r.name").distinct()


@query("julian_dates", "SELECT image_id, round(epoch_us(date_obs) / 86400e6 + 2440587.5, 6) AS jd, round(epoch_us(date_obs) / 86400e6 + 2440587.5 - 2400000.5, 6) AS mjd, round(epoch_us(date_obs) / 86400e6 + 2440587.5 - 2400000.5 + exptime / 172800, 6) AS mjd_mid FROM frames WHERE date_obs IS NOT NULL")
def julian_dates(t):
    jd = P.julian_date(c("date_obs"))
    return t.frames.where("date_obs IS NOT NULL").select("image_id", r(jd).alias("jd"), r(jd - 2400000.5).alias("mjd"), r(jd - 2400000.5 + c("exptime") / 172800).alias("mjd_mid"))


@query("header_summary", "SELECT k AS key, count(*) AS n, count(DISTINCT header[k]) AS n_values, min(header[k]) AS least FROM (SELECT header, unnest(map_keys(header)) AS k FROM frames) GROUP BY ALL")
def header_summary(t):
    return t.frames.select(F.explode("header").alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"))


@query("file_order", r"SELECT file_name, CAST(coalesce(nullif(regexp_extract(file_name, '^([0-9]+)_', 1), ''), nullif(regexp_extract(file_name, '([0-9]+)', 1), '')) AS BIGINT) AS number, lower(regexp_extract(file_name, '\.([A-Za-z]+)$', 1)) AS suffix FROM frames WHERE regexp_matches(lower(file_name), '\.fits?$')")
def file_order(t):
    """FITS files with the number they are put in order by: what stands before the first underscore, else the first digits."""
    return t.frames.where(F.lower("file_name").rlike(r"\.fits?$")).select("file_name", F.coalesce(*(F.nullif(F.regexp_extract("file_name", p, 1), F.lit("")) for p in (r"^([0-9]+)_", r"([0-9]+)"))).cast("long").alias("number"), F.lower(F.regexp_extract("file_name", r"\.([A-Za-z]+)$", 1)).alias("suffix"))


@query("distance_filter", "SELECT vec_id, round(1 / (abs(embedding[1]::DOUBLE) * 10), 6) AS kpc FROM embeddings WHERE embedding[1] <> 0 AND 1 / (abs(embedding[1]::DOUBLE) * 10) <= 6")
def distance_filter(t):
    kpc = P.distance_kpc(F.abs(c("embedding")[0].cast("double")) * 10)
    return t.embeddings.where(kpc <= 6).select("vec_id", r(kpc).alias("kpc"))


@query("pm_box", "WITH m AS (SELECT quantile_cont(embedding[1]::DOUBLE * 10, 0.5) a, quantile_cont(embedding[2]::DOUBLE * 10, 0.5) b FROM embeddings) SELECT vec_id FROM embeddings, m WHERE embedding[1]::DOUBLE * 10 > a - 0.8 AND embedding[1]::DOUBLE * 10 < a + 0.8 AND embedding[2]::DOUBLE * 10 > b - 0.8 AND embedding[2]::DOUBLE * 10 < b + 0.8")
def pm_box(t):
    """Stars around the median proper motion; the medians are exact and found without a task that sees all values."""
    d = t.embeddings.select("vec_id", (c("embedding")[0].cast("double") * 10).alias("a"), (c("embedding")[1].cast("double") * 10).alias("b"))
    return d.where(P.in_open_box(c("a"), exact_median(d, "a"), 0.8) & P.in_open_box(c("b"), exact_median(d, "b"), 0.8)).select("vec_id")


@query("magnitude_system", "SELECT cal_id, round(CASE WHEN mag_v - mag_r <= 0.93 THEN mag_r + 0.267 * (mag_v - mag_r) + 0.088 ELSE mag_r + 0.77 * (mag_v - mag_r) - 0.37 END, 6) AS r_prime, round(mag_v + 0.63 * (mag_b - mag_v) - 0.124, 6) AS g_prime FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL AND mag_r IS NOT NULL")
def magnitude_system(t):
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL AND mag_r IS NOT NULL")
    return d.select("cal_id", r(P.sdss_r(c("mag_v"), c("mag_r"))).alias("r_prime"), r(P.sdss_g(c("mag_b"), c("mag_v"))).alias("g_prime"))


@query("extinction", "SELECT auid, round(mag_v - 3.1 * 0.12 - 8.5, 6) AS abs_v, round(mag_b - (3.1 + 1) * 0.12 - 8.5, 6) AS abs_b, round(mag_b - mag_v - 0.12, 6) AS colour_0 FROM comp_stars WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL")
def extinction(t):
    a_v, a_b = P.extinction_bv(0.12)
    d = t.comp_stars.where("mag_b IS NOT NULL AND mag_v IS NOT NULL")
    return d.select("auid", r(c("mag_v") - a_v - 8.5).alias("abs_v"), r(c("mag_b") - a_b - 8.5).alias("abs_b"), r(c("mag_b") - c("mag_v") - (a_b - a_v)).alias("colour_0"))


GAIN = [(0.0, 1.0), (20.0, 0.8), (40.0, 0.5), (56.0, 0.31), (80.0, 0.2)]


@query("spline_lookup", f"""WITH k AS (SELECT x, y, lead(x) OVER (ORDER BY x) x1, lead(y) OVER (ORDER BY x) y1 FROM {sql_values(GAIN, "x, y")})
    SELECT image_id, round(coalesce(y + (y1 - y) * (gain - x) / (x1 - x), y), 6) AS e_per_adu FROM frames JOIN k ON gain >= x AND (gain < x1 OR (x1 IS NULL AND gain = x))""")
def spline_lookup(t):
    return t.frames.select("image_id", r(P.piecewise_linear(c("gain"), GAIN)).alias("e_per_adu")).where("e_per_adu IS NOT NULL")


@query("fold_phase", f"""SELECT image_id, name, round(CAST((jd - t0_jd) / period_d - floor((jd - t0_jd) / period_d) AS DOUBLE), 5) AS phase
    FROM (SELECT DISTINCT image_id, object_name FROM frames) f JOIN {SQL_TIMES} i USING (image_id) JOIN targets ON object_name = name WHERE period_d > 0 AND t0_jd IS NOT NULL AND jd IS NOT NULL""")
def fold_phase(t):
    """Phase of every frame of a periodic target, a missing jd taken from date_obs."""
    f = t.frames.select("image_id", "object_name").distinct().join(image_times(t.frames), "image_id").where("jd IS NOT NULL")
    g = t.targets.where("period_d > 0 AND t0_jd IS NOT NULL")
    return f.join(g, c("object_name") == c("name")).select("image_id", "name", r(P.phase(c("jd"), c("t0_jd"), c("period_d")), 5).alias("phase"))


@query("separations", f"SELECT auid, round({sql_separation('ra_deg', 'dec_deg', '180.0', '0.0')}, 3) AS sep FROM comp_stars")
def separations(t):
    return t.comp_stars.select("auid", r(separation_arcsec(c("ra_deg"), c("dec_deg"), F.lit(180.0), F.lit(0.0)), 3).alias("sep"))


@query("nested_bands", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def nested_bands(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


_R1 = "CASE WHEN mag_v - mag_r <= 0.93 THEN mag_r + 0.267 * (mag_v - mag_r) + 0.088 ELSE mag_r + 0.77 * (mag_v - mag_r) - 0.37 END"


@query("magnitude_system_uiz", f"SELECT cal_id, round(mag_v + 0.63 * (mag_b - mag_v) - 0.124 + 0.75 * (mag_u - mag_b) + 0.77 * (mag_b - mag_v) + 0.72, 7) AS u_prime, round(mag_i + 0.247 * (mag_r - mag_i) + 0.236, 7) AS i_prime, round({_R1} - 1.584 * (mag_r - mag_i) + 0.386, 7) AS z_prime FROM calib")
def magnitude_system_uiz(t):
    return t.calib.select("cal_id", r(P.sdss_u(c("mag_u"), c("mag_b"), c("mag_v")), 7).alias("u_prime"), r(P.sdss_i(c("mag_r"), c("mag_i")), 7).alias("i_prime"), r(P.sdss_z(c("mag_v"), c("mag_r"), c("mag_i")), 7).alias("z_prime"))


#: A(band) / E(B-V) at R = 3.1 and 4, worked out apart from the engine: a cubic for each piece, by the conditions of the spline.
_PER_EXCESS = {"U": (4.793311, 5.666908), "B": (4.077215, 4.980411), "V": (3.071276, 3.972280), "R": (2.440911, 3.312409), "I": (1.719610, 2.358880)}


@query("extinction_curve", "SELECT cal_id, " + ", ".join(f"round(mag_{b.lower()} - 0.12 * {a!r}, 4) AS {b.lower()}_0, round(mag_{b.lower()} - 0.3 * {d!r}, 4) AS {b.lower()}_dense" for b, (a, d) in _PER_EXCESS.items()) + " FROM calib")
def extinction_curve(t):
    """Magnitudes without interstellar extinction, by the mean Galactic curve at each band's wavelength, for the usual ratio and for
    that of a dense cloud."""
    bands = P.EFFECTIVE_WAVELENGTH.items()
    return t.calib.select("cal_id", *(r(c(f"mag_{b.lower()}") - P.extinction_at(w, e, ratio), 4).alias(f"{b.lower()}_{name}") for b, w in bands for e, ratio, name in ((0.12, 3.1, "0"), (0.3, 4.0, "dense"))))


DARK_CURRENT = [(-30.0, 0.002), (-20.0, 0.006), (-10.0, 0.02), (0.0, 0.07)]


@query("dark_current", "SELECT image_id, round(CASE WHEN ccd_temp < -20 THEN 0.002 + 0.004 * (ccd_temp + 30) / 10 WHEN ccd_temp < -10 THEN 0.006 + 0.014 * (ccd_temp + 20) / 10 ELSE 0.02 + 0.05 * (ccd_temp + 10) / 10 END, 6) AS rate FROM frames WHERE ccd_temp IS NOT NULL")
def dark_current(t):
    """Dark current at the temperature of each frame, from a table of the camera, extrapolated beyond its ends."""
    return t.frames.where("ccd_temp IS NOT NULL").select("image_id", r(P.extrapolated_linear(c("ccd_temp"), DARK_CURRENT)).alias("rate"))


@query("magnitude_system_first", f"SELECT cal_id, CASE WHEN mag_v IS NOT NULL AND mag_b IS NOT NULL THEN round(mag_v + 0.63 * (mag_b - mag_v) - 0.124, 6) ELSE NULL END AS g_prime, round(coalesce({_R1}, mag_r), 6) AS r_prime, round(coalesce(mag_i + 0.247 * (mag_r - mag_i) + 0.236, mag_i), 6) AS i_prime, CASE WHEN mag_v IS NOT NULL AND mag_r IS NOT NULL THEN 'V, R' WHEN mag_r IS NOT NULL THEN 'R' END AS r_from FROM calib")
def magnitude_system_first(t):
    """Bands of another system by the first rule whose magnitudes are all there; where no rule applies, the nearest band as it is."""
    first = lambda *rules: F.coalesce(*rules)
    how = F.when(c("mag_v").isNotNull() & c("mag_r").isNotNull(), F.lit("V, R")).when(c("mag_r").isNotNull(), F.lit("R"))
    return t.calib.select("cal_id", r(P.sdss_g(c("mag_b"), c("mag_v"))).alias("g_prime"), r(first(P.sdss_r(c("mag_v"), c("mag_r")), c("mag_r"))).alias("r_prime"), r(first(P.sdss_i(c("mag_r"), c("mag_i")), c("mag_i"))).alias("i_prime"), how.alias("r_from"))


@query("isochrone_magnitudes", "WITH i AS (SELECT vec_id, label, 5 + 1.5 * embedding[1]::DOUBLE AS v, embedding[2]::DOUBLE AS b_v, embedding[3]::DOUBLE AS v_r FROM embeddings) SELECT vec_id, label AS isochrone, round(v, 6) AS v, round(v + b_v, 6) AS b, round(v - v_r, 6) AS r FROM i")
def isochrone_magnitudes(t):
    """Magnitudes of the points of isochrones that give one magnitude and colours, each from the one before: B = V + (B-V),
    R = V - (V-R)."""
    e = lambda k: c("embedding")[k].cast("double")
    v = 5 + 1.5 * e(0)
    return t.embeddings.select("vec_id", c("label").alias("isochrone"), r(v).alias("v"), r(v + e(1)).alias("b"), r(v - e(2)).alias("r"))
