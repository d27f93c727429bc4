"""Ordered operators, pixel planes in relational form, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.operators.clip import array_median
from photoloom.operators.spikes import image_times
from photoloom.plans.registry import Registry, Tables, r

query = Registry()
c = F.col

_DAY = "(SELECT image_id, min(object_name) AS o, min(filter_name) AS f, min(ccd_temp) AS temp, coalesce(min(jd), min(epoch_us(date_obs) / 86400e6 + 2440587.5)) AS jd FROM frames GROUP BY image_id)"


def _frames(t: Tables):
    f = t.frames.groupBy("image_id").agg(F.min("object_name").alias("o"), F.min("filter_name").alias("f"), F.min("ccd_temp").alias("temp"))
    return f.join(image_times(t.frames), "image_id").where("jd IS NOT NULL").withColumn("night", F.floor("jd").cast("long"))


_BY = "PARTITION BY o, floor(jd) ORDER BY jd, image_id"


@query("running_median", f"SELECT image_id, round(quantile_cont(temp, 0.5) OVER ({_BY} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS median FROM {_DAY} WHERE jd IS NOT NULL AND temp IS NOT NULL")
def running_median(t):
    near = W.partitionBy("o", "night").orderBy("jd", "image_id").rowsBetween(-4, 4)
    d = _frames(t).where("temp IS NOT NULL").withColumn("a", F.array_sort(F.collect_list("temp").over(near)))
    return d.select("image_id", r(array_median(c("a"))).alias("median"))


@query("shift_outlier", f"SELECT image_id, abs(temp - quantile_cont(temp, 0.5) OVER ({_BY} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) > 0.45 AS odd FROM {_DAY} WHERE jd IS NOT NULL AND temp IS NOT NULL")
def shift_outlier(t):
    near = W.partitionBy("o", "night").orderBy("jd", "image_id").rowsBetween(-4, 4)
    d = _frames(t).where("temp IS NOT NULL").withColumn("a", F.array_sort(F.collect_list("temp").over(near)))
    return d.select("image_id", (F.abs(c("temp") - array_median(c("a"))) > 0.45).alias("odd"))


@query("gaps_islands", "WITH d AS (SELECT DISTINCT object_id, image_id // 8 AS block FROM photometry), n AS (SELECT object_id, block, block - row_number() OVER (PARTITION BY object_id ORDER BY block) AS g FROM d) SELECT object_id, min(block) AS first, max(block) AS last, count(*) AS n FROM n GROUP BY object_id, g")
def gaps_islands(t, span: int = 1024):
    """Runs of blocks in which an object is seen.  Islands are found within spans of blocks first, so that an object that is seen
    all the time is spread; then islands that meet at the ends of spans are joined, a few rows for each object."""
    d = t.photometry.select("object_id", F.floor(c("image_id") / 8).cast("long").alias("block")).distinct().withColumn("span", F.floor(c("block") / span))
    n = d.withColumn("g", c("block") - F.row_number().over(W.partitionBy("object_id", "span").orderBy("block")))
    parts = n.groupBy("object_id", "span", "g").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.count("*").alias("n"))
    order = W.partitionBy("object_id").orderBy("first")
    parts = parts.withColumn("new", F.coalesce((c("first") > F.lag("last").over(order) + 1).cast("int"), F.lit(1)))
    parts = parts.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy("object_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("island")


_FLUX = "(SELECT DISTINCT image_id, object_id, flux_fit FROM photometry WHERE flux_fit IS NOT NULL)"


@query("percentile_row_pick", f"WITH p AS (SELECT image_id, quantile_cont(flux_fit, 0.99) AS p FROM {_FLUX} GROUP BY 1), k AS (SELECT image_id, object_id, flux_fit, row_number() OVER (PARTITION BY image_id ORDER BY flux_fit, object_id) AS k FROM {_FLUX}), b AS (SELECT image_id, arg_min(k, (abs(flux_fit - p), k)) AS b FROM k JOIN p USING (image_id) GROUP BY 1) SELECT image_id, object_id FROM k JOIN b USING (image_id) WHERE k >= b - 10 AND k < b")
def percentile_row_pick(t):
    """The ten stars below the one nearest to the 99th percentile of flux, for each image."""
    d = t.photometry.where("flux_fit IS NOT NULL").select("image_id", "object_id", "flux_fit").distinct()
    one = W.partitionBy("image_id")
    d = d.withColumns({"k": F.row_number().over(one.orderBy("flux_fit", "object_id")), "p": F.percentile("flux_fit", 0.99).over(one)})
    d = d.withColumn("b", F.min(F.struct(F.abs(c("flux_fit") - c("p")).alias("d"), "k")).over(one)["k"])
    return d.where("k >= b - 10 AND k < b").select("image_id", "object_id")


@query("middle_slice", f"SELECT image_id, object_id FROM (SELECT image_id, object_id, row_number() OVER (PARTITION BY image_id ORDER BY flux_fit, object_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM {_FLUX}) WHERE n < 40 OR k BETWEEN 21 AND 40")
def middle_slice(t):
    d = t.photometry.where("flux_fit IS NOT NULL").select("image_id", "object_id", "flux_fit").distinct()
    one = W.partitionBy("image_id")
    return d.withColumns({"k": F.row_number().over(one.orderBy("flux_fit", "object_id")), "n": F.count("*").over(one)}).where("n < 40 OR k BETWEEN 21 AND 40").select("image_id", "object_id")


@query("sequence_id", f"SELECT image_id, row_number() OVER ({_BY}) - 1 AS seq FROM {_DAY} WHERE jd IS NOT NULL")
def sequence_id(t):
    return _frames(t).select("image_id", (F.row_number().over(W.partitionBy("o", "night").orderBy("jd", "image_id")) - 1).cast("long").alias("seq"))


@query("observing_blocks", f"WITH d AS (SELECT image_id, o, floor(jd) AS night, jd, CASE WHEN jd - lag(jd) OVER ({_BY}) > 0.02 THEN 1 ELSE 0 END AS new FROM {_DAY} WHERE jd IS NOT NULL) SELECT image_id, CAST(sum(new) OVER (PARTITION BY o, night ORDER BY jd, image_id) AS BIGINT) AS block FROM d")
def observing_blocks(t):
    """Running number of the record group: a pause of more than half an hour begins a new one."""
    w = W.partitionBy("o", "night").orderBy("jd", "image_id")
    d = _frames(t).withColumn("new", F.coalesce((c("jd") - F.lag("jd").over(w) > 0.02).cast("long"), F.lit(0)))
    return d.select("image_id", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("block"))


@query("crop_from_shifts", """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS image, ((l_partkey % 41) - 20)::DOUBLE / 2 AS dy, ((l_suppkey % 31) - 15)::DOUBLE / 2 AS dx FROM lineitem), g AS (SELECT min(dy) y0, max(dy) y1, min(dx) x0, max(dx) x1 FROM s)
    SELECT image, CAST(round_even(greatest(y1, 0) - dy, 0) AS BIGINT) AS top, CAST(round_even(dy - least(y0, 0), 0) AS BIGINT) AS bottom, CAST(round_even(greatest(x1, 0) - dx, 0) AS BIGINT) AS left_, CAST(round_even(dx - least(x0, 0), 0) AS BIGINT) AS right_ FROM s, g""")
def crop_from_shifts(t):
    """Rows and columns that each shifted image loses, so that all show the same field. The extremes are one global aggregate."""
    s = t.lineitem.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("image"), (((c("l_partkey") % 41) - 20) / 2).alias("dy"), (((c("l_suppkey") % 31) - 15) / 2).alias("dx"))
    g = s.agg(F.min("dy").alias("y0"), F.max("dy").alias("y1"), F.min("dx").alias("x0"), F.max("dx").alias("x1")).first()
    even = lambda x: F.bround(x, 0).cast("long")
    y0, y1, x0, x1 = (F.lit(v) for v in (min(g["y0"] or 0, 0.0), max(g["y1"] or 0, 0.0), min(g["x0"] or 0, 0.0), max(g["x1"] or 0, 0.0)))
    return s.select("image", even(y1 - c("dy")).alias("top"), even(c("dy") - y0).alias("bottom"), even(x1 - c("dx")).alias("left_"), even(c("dx") - x0).alias("right_"))


@query("light_curve_bins", "SELECT object_id, filter_name, floor(phase / 0.05)::BIGINT AS bin, count(*) AS n, round(avg(m), 9) AS mag FROM (SELECT p.object_id, p.filter_name, p.mag_cali_trans AS m, (f.jd - 2450000.0) / 2.5 - floor((f.jd - 2450000.0) / 2.5) AS phase FROM (SELECT DISTINCT image_id, object_id, filter_name, mag_cali_trans FROM photometry WHERE mag_cali_trans BETWEEN 5 AND 30) p JOIN " + _DAY + " f USING (image_id)) GROUP BY ALL")
def light_curve_bins(t):
    """Folded light curves: the mean magnitude of each twentieth of a period; empty bins have no row."""
    d = t.photometry.where("mag_cali_trans BETWEEN 5 AND 30").select("image_id", "object_id", "filter_name", "mag_cali_trans").distinct().join(image_times(t.frames), "image_id")
    turns = (c("jd") - 2450000.0) / 2.5
    return d.groupBy("object_id", "filter_name", F.floor((turns - F.floor(turns)) / 0.05).cast("long").alias("bin")).agg(F.count("*").alias("n"), r(F.avg("mag_cali_trans"), 9).alias("mag"))


_PIX = "(SELECT l_linenumber AS image, (l_partkey % 32)::INT AS y, (l_suppkey % 32)::INT AS x, l_quantity AS v FROM lineitem)"


def pixels(t: Tables):
    return t.lineitem.select(c("l_linenumber").alias("image"), (c("l_partkey") % 32).cast("int").alias("y"), (c("l_suppkey") % 32).cast("int").alias("x"), c("l_quantity").cast("double").alias("v"))


@query("pixel_stack", f"SELECT y, x, count(*) AS n, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median, sum(v) AS total FROM {_PIX} GROUP BY y, x")
def pixel_stack(t):
    return pixels(t).groupBy("y", "x").agg(F.count("*").alias("n"), r(F.avg("v"), 9).alias("mean"), r(F.percentile("v", 0.5), 9).alias("median"), F.sum("v").alias("total"))


@query("flat_scale", f"WITH p AS (SELECT image, y, x, avg(v) AS v FROM {_PIX} GROUP BY ALL), m AS (SELECT image, quantile_cont(v, 0.5) AS m FROM p GROUP BY 1) SELECT image, y, x, round(v / m, 9) AS v FROM p JOIN m USING (image)")
def flat_scale(t):
    p = pixels(t).groupBy("image", "y", "x").agg(F.avg("v").alias("v"))
    m = p.groupBy("image").agg(F.percentile("v", 0.5).alias("m"))
    return p.join(m, "image").select("image", "y", "x", r(c("v") / c("m"), 9).alias("v"))


@query("block_average", f"SELECT image, y // 4 AS by_, x // 4 AS bx, count(*) AS n, round(avg(v), 9) AS v FROM {_PIX} GROUP BY ALL")
def block_average(t):
    return pixels(t).groupBy("image", F.floor(c("y") / 4).cast("int").alias("by_"), F.floor(c("x") / 4).cast("int").alias("bx")).agg(F.count("*").alias("n"), r(F.avg("v"), 9).alias("v"))


@query("mask_or", f"SELECT y, x, bool_or(v > 49) AS masked FROM {_PIX} GROUP BY y, x")
def mask_or(t):
    return pixels(t).groupBy("y", "x").agg(F.bool_or(c("v") > 49).alias("masked"))


@query("hot_pixel_threshold", f"SELECT image, min(t) AS threshold FROM (SELECT image, t, avg(CASE WHEN v > t THEN 1.0 ELSE 0.0 END) AS share FROM {_PIX} p, generate_series(2, 101) g(t) GROUP BY ALL) WHERE share <= 0.03 GROUP BY image")
def hot_pixel_threshold(t):
    """The smallest whole threshold that at most three per cent of the pixels exceed: counts of whole values, then running shares."""
    h = pixels(t).groupBy("image", F.least(F.greatest(F.ceil("v"), F.lit(0)), F.lit(102)).alias("b")).agg(F.count("*").alias("n"))
    a = h.groupBy("image").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    above = lambda t_: F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] > t_, e["value"]).otherwise(0))
    good = F.filter(F.sequence(F.lit(2), F.lit(101)), lambda t_: above(t_) / c("all") <= 0.03)
    return a.select("image", F.array_min(good).cast("long").alias("threshold")).where("threshold IS NOT NULL")


@query("pier_flip", f"SELECT image, 31 - y AS y, 31 - x AS x, sum(v) AS v FROM {_PIX} WHERE image % 2 = 0 GROUP BY ALL UNION ALL SELECT image, y, x, sum(v) AS v FROM {_PIX} WHERE image % 2 = 1 GROUP BY ALL")
def pier_flip(t):
    turn = lambda a: F.when(c("image") % 2 == 0, 31 - c(a)).otherwise(c(a)).alias(a)
    return pixels(t).groupBy("image", turn("y"), turn("x")).agg(F.sum("v").alias("v"))


@query("files_not_reduced", "SELECT file_name FROM frames WHERE imagetyp = 'Light Frame' EXCEPT SELECT file_name FROM frames WHERE combined OR enlarged OR exptime > 100")
def files_not_reduced(t):
    return t.frames.where("imagetyp = 'Light Frame'").select("file_name").subtract(t.frames.where("combined OR enlarged OR exptime > 100").select("file_name"))


@query("master_coverage", "SELECT l.instrume, l.exptime, bool_or(d.instrume IS NOT NULL) AS covered FROM (SELECT DISTINCT instrume, exptime FROM frames WHERE imagetyp = 'Light Frame' AND instrume IS NOT NULL) l LEFT JOIN (SELECT DISTINCT instrume, exptime FROM frames WHERE imagetyp = 'Dark Frame') d USING (instrume, exptime) GROUP BY ALL")
def master_coverage(t):
    light = t.frames.where("imagetyp = 'Light Frame' AND instrume IS NOT NULL").select("instrume", "exptime").distinct()
    dark = t.frames.where("imagetyp = 'Dark Frame'").select("instrume", "exptime").distinct().withColumn("d", F.lit(True))
    return light.join(dark, ["instrume", "exptime"], "left").select("instrume", "exptime", F.coalesce("d", F.lit(False)).alias("covered"))


@query("event_light_curve", "SELECT event_type, floor(epoch_us(ts) / 3.6e9)::BIGINT AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY ALL")
def event_light_curve(t):
    from photoloom.streaming.bins import hourly

    return hourly(t.events)
