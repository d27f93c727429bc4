"""Cross-matches, nearest joins, look-ups and anti-joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.operators.nearest import mutual_best, nearest_on_axis, unambiguous
from photoloom.operators.spatial import pixel_pairs, sky_pairs
from photoloom.operators.spikes import image_times
from photoloom.plans.projections import SQL_TIMES, WCS, WCS_COLUMNS, solutions, sql_separation
from photoloom.plans.registry import Registry, Tables, r, sql_values
from photoloom.functions.sky import sky_to_pixel

query = Registry()
c = F.col

POINTS = "(SELECT DISTINCT image_id, object_id, x_fit AS x, y_fit AS y FROM photometry WHERE x_fit IS NOT NULL AND y_fit IS NOT NULL)"
#: Detections of each image beside those of the next one, within 60 pixels.
NEXT = f"SELECT a.image_id, a.object_id AS a_id, b.object_id AS b_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM {POINTS} a JOIN {POINTS} b ON b.image_id = a.image_id + 1 WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 3600"


def points(t: Tables):
    return t.photometry.where("x_fit IS NOT NULL AND y_fit IS NOT NULL").select("image_id", "object_id", c("x_fit").alias("x"), c("y_fit").alias("y")).distinct()


def next_pairs(t: Tables):
    p = points(t)
    d = pixel_pairs(p, p.withColumn("image_id", c("image_id") - 1), 60, by=["image_id"])
    return d.select("l.image_id", c("l.object_id").alias("a_id"), c("r.object_id").alias("b_id"), "dist")


@query("xmatch_pixel", f"SELECT image_id, a_id, b_id, round(dist, 6) AS dist FROM ({NEXT})")
def xmatch_pixel(t):
    return next_pairs(t).withColumn("dist", r("dist"))


@query("xmatch_all_pairs", f"SELECT a.image_id, a.object_id AS a_id, b.object_id AS b_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS dist FROM {POINTS} a JOIN {POINTS} b ON a.image_id = b.image_id AND a.object_id < b.object_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 3600")
def xmatch_all_pairs(t):
    p = points(t)
    d = pixel_pairs(p, p, 60, by=["image_id"]).where("l.object_id < r.object_id")
    return d.select("l.image_id", c("l.object_id").alias("a_id"), c("r.object_id").alias("b_id"), r("dist").alias("dist"))


@query("crowded", f"SELECT image_id, object_id, n FROM (SELECT a.image_id, a.object_id, count(*) AS n FROM {POINTS} a JOIN {POINTS} b ON a.image_id = b.image_id AND a.object_id <> b.object_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 3600 GROUP BY ALL)")
def crowded(t):
    p = points(t)
    return pixel_pairs(p, p, 60, by=["image_id"]).where("l.object_id <> r.object_id").groupBy("l.image_id", "l.object_id").agg(F.count("*").alias("n"))


@query("xmatch_mutual_best", f"""WITH p AS ({NEXT}), a AS (SELECT *, rank() OVER (PARTITION BY image_id, a_id ORDER BY dist) k FROM p), b AS (SELECT image_id, a_id, b_id, dist, rank() OVER (PARTITION BY image_id, b_id ORDER BY dist) k FROM a WHERE k = 1)
    SELECT image_id, a_id, b_id, round(dist, 6) AS dist FROM b WHERE k = 1""")
def xmatch_mutual_best(t):
    return mutual_best(next_pairs(t), ["image_id", "a_id"], ["image_id", "b_id"], "dist").withColumn("dist", r("dist"))


@query("xmatch_unambiguous", f"""WITH p AS ({NEXT}), a AS (SELECT *, count(*) OVER (PARTITION BY image_id, a_id) k FROM p), b AS (SELECT image_id, a_id, b_id, dist, count(*) OVER (PARTITION BY image_id, b_id) k FROM a WHERE k = 1)
    SELECT image_id, a_id, b_id, round(dist, 6) AS dist FROM b WHERE k = 1""")
def xmatch_unambiguous(t):
    return unambiguous(next_pairs(t), ["image_id", "a_id"], ["image_id", "b_id"]).withColumn("dist", r("dist"))


@query("xmatch_nearest_of_many", f"SELECT image_id, b_id, arg_min(a_id, (dist, a_id)) AS a_id, round(min(dist), 6) AS dist FROM ({NEXT}) GROUP BY image_id, b_id")
def xmatch_nearest_of_many(t):
    best = next_pairs(t).groupBy("image_id", "b_id").agg(F.min(F.struct("dist", "a_id")).alias("m"))
    return best.select("image_id", "b_id", "m.a_id", r("m.dist").alias("dist"))


_STARS = "(SELECT DISTINCT auid, ra_deg, dec_deg FROM comp_stars)"


@query("xmatch_sky", f"SELECT a.auid AS a_id, b.auid AS b_id, round({sql_separation('a.ra_deg', 'a.dec_deg', 'b.ra_deg', 'b.dec_deg')}, 3) AS sep FROM {_STARS} a JOIN {_STARS} b ON a.auid < b.auid AND {sql_separation('a.ra_deg', 'a.dec_deg', 'b.ra_deg', 'b.dec_deg')} <= 60")
def xmatch_sky(t):
    s = t.comp_stars.select("auid", "ra_deg", "dec_deg").distinct()
    return sky_pairs(s, s, 60).where("l.auid < r.auid").select(c("l.auid").alias("a_id"), c("r.auid").alias("b_id"), r("sep_arcsec", 3).alias("sep"))


@query("target_lookup", f"SELECT name, arg_min(auid, (sep, auid)) AS auid, round(min(sep), 3) AS sep FROM (SELECT name, auid, {sql_separation('g.ra_deg', 'g.dec_deg', 'k.ra_deg', 'k.dec_deg')} AS sep FROM targets g JOIN {_STARS} k ON {sql_separation('g.ra_deg', 'g.dec_deg', 'k.ra_deg', 'k.dec_deg')} <= 900) GROUP BY name")
def target_lookup(t):
    p = sky_pairs(t.comp_stars.select("auid", "ra_deg", "dec_deg"), t.targets.select("name", "ra_deg", "dec_deg"), 900)
    best = p.groupBy("r.name").agg(F.min(F.struct("sep_arcsec", "l.auid")).alias("m"))
    return best.select("name", "m.auid", r("m.sep_arcsec", 3).alias("sep"))


@query("anti_target", f"SELECT auid, chart FROM comp_stars k WHERE NOT EXISTS (SELECT 1 FROM targets g WHERE {sql_separation('g.ra_deg', 'g.dec_deg', 'k.ra_deg', 'k.dec_deg')} <= 420)")
def anti_target(t):
    near = sky_pairs(t.comp_stars.select("auid", "ra_deg", "dec_deg").distinct(), t.targets, 420).select("l.*").distinct()
    return t.comp_stars.join(near, ["auid", "ra_deg", "dec_deg"], "left_anti").select("auid", "chart")


_TOWARDS = "(sin(radians(crval2)) * sin(radians(dec_deg)) + cos(radians(crval2)) * cos(radians(dec_deg)) * cos(radians(ra_deg - crval1)))"
_XI = f"degrees(cos(radians(dec_deg)) * sin(radians(ra_deg - crval1)) / {_TOWARDS})"
_ETA = f"degrees((cos(radians(crval2)) * sin(radians(dec_deg)) - sin(radians(crval2)) * cos(radians(dec_deg)) * cos(radians(ra_deg - crval1))) / {_TOWARDS})"
_DET = "(cd11 * cd22 - cd12 * cd21)"


@query("fov_filter", f"""WITH w AS (SELECT * FROM {WCS} JOIN (SELECT image_id, min(naxis1) AS nx, min(naxis2) AS ny FROM frames GROUP BY image_id) USING (image_id)),
    p AS (SELECT image_id, auid, nx, ny, (cd22 * {_XI} - cd12 * {_ETA}) / {_DET} + crpix1 - 1 AS x, (cd11 * {_ETA} - cd21 * {_XI}) / {_DET} + crpix2 - 1 AS y FROM w JOIN {_STARS} k ON {sql_separation('crval1', 'crval2', 'ra_deg', 'dec_deg')} <= 1800)
    SELECT image_id, auid, round(x, 3) AS x, round(y, 3) AS y FROM p WHERE x >= 0 AND x <= nx - 1 AND y >= 0 AND y <= ny - 1""")
def fov_filter(t):
    """Listed stars that fall into each solved image: a sky join around the images' centres, then the pixel bounds."""
    size = t.frames.groupBy("image_id").agg(F.min("naxis1").alias("nx"), F.min("naxis2").alias("ny"))
    w = solutions(t).join(size, "image_id")
    p = sky_pairs(w.withColumns({"_ra": c("crval1"), "_dec": c("crval2")}), t.comp_stars.select("auid", "ra_deg", "dec_deg").distinct(), 1800, left_pos=("_ra", "_dec"))
    x, y = sky_to_pixel(c("r.ra_deg"), c("r.dec_deg"), {k: c(f"l.{k}") for k in WCS_COLUMNS})
    d = p.select("l.image_id", "r.auid", x.alias("x"), y.alias("y"), "l.nx", "l.ny")
    return d.where("x >= 0 AND x <= nx - 1 AND y >= 0 AND y <= ny - 1").select("image_id", "auid", r("x", 3).alias("x"), r("y", 3).alias("y"))


def _timed(t: Tables):
    times = image_times(t.frames)
    f = t.frames.groupBy("image_id").agg(F.min("filter_name").alias("f"), F.min("object_name").alias("o"))
    return f.join(times, "image_id").where("o IS NOT NULL AND jd IS NOT NULL")


@query("nearest_time_other_filter", f"""WITH d AS (SELECT * FROM {SQL_TIMES} WHERE o IS NOT NULL AND jd IS NOT NULL), v AS (SELECT * FROM d WHERE f = 'V'), b AS (SELECT o, jd, min(image_id) AS image_id FROM d WHERE f = 'B' GROUP BY ALL),
    p AS (SELECT v.image_id, v.jd, b.image_id AS p_id, b.jd AS p_jd FROM v ASOF LEFT JOIN b ON v.o = b.o AND v.jd >= b.jd),
    n AS (SELECT v.image_id, b.image_id AS n_id, b.jd AS n_jd FROM v ASOF LEFT JOIN b ON v.o = b.o AND v.jd <= b.jd)
    SELECT image_id, CASE WHEN p_id IS NULL OR n_jd - jd < jd - p_jd THEN n_id ELSE p_id END AS near_image_id FROM p JOIN n USING (image_id)""")
def nearest_time_other_filter(t):
    """The image of the second filter nearest in time, over all nights of the object."""
    d = _timed(t)
    return nearest_on_axis(d.where("f = 'V'"), d.where("f = 'B'"), ["o"], "jd", "image_id", period=1.0).select("image_id", "near_image_id")


_EXPOSED = "SELECT instrume, image_id, exptime FROM frames WHERE imagetyp = '{}' AND instrume IS NOT NULL AND exptime IS NOT NULL"


@query("nearest_exposure", f"""WITH l AS ({_EXPOSED.format('Light Frame')}), d AS ({_EXPOSED.format('Dark Frame')}), g AS (SELECT DISTINCT instrume, exptime FROM l),
    n AS (SELECT g.instrume, g.exptime, arg_min(d.image_id, (abs(d.exptime - g.exptime), d.exptime, d.image_id)) AS near_image_id, min(abs(d.exptime - g.exptime)) AS gap FROM g JOIN d ON g.instrume = d.instrume GROUP BY ALL)
    SELECT image_id, near_image_id, gap <= 0.5 AS covered FROM l LEFT JOIN n USING (instrume, exptime)""")
def nearest_exposure(t):
    d = t.frames.where("instrume IS NOT NULL AND exptime IS NOT NULL").select("imagetyp", "instrume", "image_id", "exptime")
    light, dark = d.where("imagetyp = 'Light Frame'").drop("imagetyp"), d.where("imagetyp = 'Dark Frame'").drop("imagetyp")
    # One look-up for each exposure that occurs, however many frames have it.
    near = nearest_on_axis(light.select("instrume", "exptime").distinct(), dark, ["instrume"], "exptime", "image_id")
    return light.join(near, ["instrume", "exptime"], "left").select("image_id", "near_image_id", (F.abs(c("near_exptime") - c("exptime")) <= 0.5).alias("covered"))


@query("exposure_uncovered", "SELECT DISTINCT instrume, exptime FROM frames l WHERE imagetyp = 'Light Frame' AND instrume IS NOT NULL AND exptime IS NOT NULL AND NOT EXISTS (SELECT 1 FROM frames d WHERE d.imagetyp = 'Dark Frame' AND d.instrume = l.instrume AND abs(d.exptime - l.exptime) <= 0.5)")
def exposure_uncovered(t):
    light = t.frames.where("imagetyp = 'Light Frame' AND instrume IS NOT NULL AND exptime IS NOT NULL").select("instrume", "exptime").distinct()
    dark = t.frames.where("imagetyp = 'Dark Frame'").select(c("instrume").alias("i"), c("exptime").alias("e")).distinct()
    return light.join(dark, (c("instrume") == c("i")) & (F.abs(c("exptime") - c("e")) <= 0.5), "left_anti")


COEFFICIENTS = [(2450000.0, "V", 0.05, -0.012), (2450040.0, "V", 0.047, -0.011), (2450090.0, "V", 0.051, -0.013), (2450000.0, "B", 0.11, -0.02), (2450060.0, "B", 0.105, -0.018)]


@query("coeff_asof", f"SELECT image_id, t1, k1 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY start_jd DESC) AS n FROM {SQL_TIMES} f JOIN {sql_values(COEFFICIENTS, 'start_jd, filter, t1, k1')} ON f.f = filter AND start_jd <= jd) WHERE n = 1")
def coeff_asof(t):
    sets = t.values(COEFFICIENTS, "start_jd double, filter string, t1 double, k1 double")
    d = t.frames.groupBy("image_id").agg(F.min("filter_name").alias("f")).join(image_times(t.frames), "image_id")
    return d.join(sets, (c("f") == c("filter")) & (c("start_jd") <= c("jd"))).groupBy("image_id").agg(F.max_by(F.struct("t1", "k1"), "start_jd").alias("s")).select("image_id", "s.t1", "s.k1")


@query("valid_filter_pairs", "SELECT object_id, a.f || '-' || b.f AS pair FROM (SELECT DISTINCT object_id, filter_name f FROM photometry) a JOIN (SELECT DISTINCT object_id, filter_name f FROM photometry) b USING (object_id) WHERE a.f || '-' || b.f IN ('U-V', 'B-V', 'V-R', 'V-I')")
def valid_filter_pairs(t):
    seen = t.photometry.groupBy("object_id").agg(F.collect_set("filter_name").alias("s"))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ("UV", "BV", "VR", "VI")))
    both = F.filter(pairs, lambda p: F.array_contains("s", p["a"]) & F.array_contains("s", p["b"]))
    return seen.select("object_id", F.explode(both).alias("p")).select("object_id", F.concat_ws("-", "p.a", "p.b").alias("pair"))


@query("nway_intersect", """WITH d AS (SELECT DISTINCT object_name AS o, image_id, object_id FROM photometry JOIN (SELECT image_id, min(object_name) AS object_name FROM frames GROUP BY image_id) USING (image_id) WHERE object_name IS NOT NULL),
    sets AS (SELECT o, count(DISTINCT image_id) AS n FROM d GROUP BY o), seen AS (SELECT o, object_id, count(*) AS k FROM d GROUP BY ALL),
    good AS (SELECT o, object_id FROM seen JOIN sets USING (o) WHERE k >= 0.8 * n), ref AS (SELECT o, count(*) AS m FROM good GROUP BY o),
    kept AS (SELECT d.o, d.image_id FROM d JOIN good USING (o, object_id) JOIN ref ON ref.o = d.o GROUP BY d.o, d.image_id, m HAVING count(*) >= 0.8 * m), n2 AS (SELECT o, count(*) AS n FROM kept GROUP BY o)
    SELECT d.o AS object_name, d.object_id, count(*) AS n_images FROM d JOIN good USING (o, object_id) JOIN kept USING (o, image_id) JOIN n2 ON n2.o = d.o GROUP BY d.o, d.object_id, n HAVING count(*) >= 0.9 * n""")
def nway_intersect(t):
    """Objects that (nearly) all images of a field share: drop objects that many images miss, then images that miss many of
    the objects left, then objects once more; each step on what the step before left."""
    name = t.frames.groupBy("image_id").agg(F.min("object_name").alias("object_name")).where("object_name IS NOT NULL")
    d = t.photometry.select("image_id", "object_id").distinct().join(name, "image_id")
    sets = name.join(d.select("image_id").distinct(), "image_id").groupBy("object_name").agg(F.count("*").alias("n"))
    seen = d.groupBy("object_name", "object_id").agg(F.count("*").alias("k"))
    good = seen.join(sets, "object_name").where("k >= 0.8 * n").select("object_name", "object_id")
    d = d.join(good, ["object_name", "object_id"])
    kept = d.groupBy("object_name", "image_id").agg(F.count("*").alias("k")).join(good.groupBy("object_name").agg(F.count("*").alias("m")), "object_name").where("k >= 0.8 * m").select("object_name", "image_id")
    n2 = kept.groupBy("object_name").agg(F.count("*").alias("n"))
    return d.join(kept, ["object_name", "image_id"]).groupBy("object_name", "object_id").agg(F.count("*").alias("n_images")).join(n2, "object_name").where("n_images >= 0.9 * n").drop("n")


ISOCHRONE = [(k, round(-0.2 + 0.06 * k, 4), round(11 + 0.2 * k + 0.004 * k * k, 4)) for k in range(30)]


@query("kdtree_1nn", f"SELECT cal_id, arg_min(k, (round(pow(mag_b - mag_v - colour, 2) + pow(mag_v - mag, 2), 9), k)) AS k FROM (SELECT DISTINCT cal_id, mag_b, mag_v FROM calib WHERE mag_b IS NOT NULL AND mag_v IS NOT NULL) JOIN {sql_values(ISOCHRONE, 'k, colour, mag')} ON true GROUP BY cal_id")
def kdtree_1nn(t):
    """The nearest point of an isochrone in colour and magnitude. Its points are a fixed list: they become a literal array."""
    d = t.calib.where("mag_b IS NOT NULL AND mag_v IS NOT NULL").select("cal_id", "mag_b", "mag_v").distinct()
    dist = [F.struct(F.round(F.pow(c("mag_b") - c("mag_v") - colour, F.lit(2)) + F.pow(c("mag_v") - mag, F.lit(2)), 9).alias("d2"), F.lit(k).alias("k")) for k, colour, mag in ISOCHRONE]
    return d.select("cal_id", F.array_min(F.array(*dist))["k"].alias("k"))


@query("region_best_star", f"SELECT name, auid, mag_v FROM (SELECT name, auid, mag_v, row_number() OVER (PARTITION BY name ORDER BY mag_v, auid) AS k FROM targets g JOIN (SELECT DISTINCT auid, ra_deg, dec_deg, mag_v FROM comp_stars WHERE mag_v IS NOT NULL) s ON {sql_separation('g.ra_deg', 'g.dec_deg', 's.ra_deg', 's.dec_deg')} <= 900) WHERE k = 1")
def region_best_star(t):
    """For each target the brightest listed star within a quarter of a degree (the other rule of the target look-up)."""
    p = sky_pairs(t.comp_stars.select("auid", "ra_deg", "dec_deg", "mag_v").where("mag_v IS NOT NULL").distinct(), t.targets.select("name", "ra_deg", "dec_deg"), 900)
    best = p.withColumn("_k", F.row_number().over(W.partitionBy("r.name").orderBy("l.mag_v", "l.auid"))).where("_k = 1")
    return best.select("r.name", "l.auid", "l.mag_v")
