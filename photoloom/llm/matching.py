"""Matching entities across sources without keys (problem 5), by loopy belief propagation.

Candidate pairs come from a sky grid.  Each pair has evidence (position, brightness in two filters); a match is a binary
variable.  Factors tie the pairs together: a star of the list belongs to at most one object, and an object takes a second star of
the list only at a price (``TWICE``), as lists name some stars twice.  Messages are exchanged through joins until they stand
still; the result is the marginal probability of every pair.

With odds ``r`` of the pairs that share a factor, the messages have closed forms, so a round is two grouped sums:

* at most one partner:      1 / (1 + sum of the other r)
* further partners at price t: P / (1 + (P - 1) / t), with P = product of (1 + t r) over the others

Scale: photometry is joined to the solutions by image and reduced to one row for each object with map-side partial sums, so a
source with a third of all rows costs nothing extra; candidate pairs and messages grow with the number of neighbouring stars.
Lists of pairs are written to the shared checkpoint folder every few rounds.

Defined results
---------------
* an object without any solved image or position, a star without a position: no match.
* a missing brightness is no evidence for or against; repeated rows count once (of rows of one auid that differ, the smallest).
* ties: an auid goes to the object of the highest marginal, then of the smallest id; empty tables give an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.functions.sky import pixel_to_sky
from photoloom.operators.spatial import sky_pairs
from photoloom.session import cut

#: Candidates lie within this distance (arc seconds): several times the scatter of a list plus the shift of a chart.
RADIUS = 12.0
#: Share of listed stars that have an object, price of a second star for an object, least marginal of a match.
PRIOR, TWICE, MATCH = 0.6, 0.2, 0.5
#: Spread of magnitudes of unrelated neighbours; share and spread of matches whose brightness is off (variables, blends).
LOOSE, ODD, ODD_SPREAD = 2.0, 0.05, 0.5
ROUNDS, STILL = 60, 1e-3
BRIGHTNESS = ("V", "B")


def object_positions(photometry: DataFrame, wcs: DataFrame) -> DataFrame:
    """object_id, ra_deg, dec_deg, bright_v, bright_b: means over the solved images of an object."""
    solution = wcs.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(*(F.min(c).alias(c) for c in ("crpix1", "crpix2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")))
    rows = photometry.where("object_id IS NOT NULL AND x_fit IS NOT NULL AND y_fit IS NOT NULL").select("image_id", "object_id", "filter_name", "x_fit", "y_fit", "mag_cali_trans")
    ra, dec = pixel_to_sky(F.col("x_fit"), F.col("y_fit"), {c: F.col(c) for c in solution.columns})
    placed = rows.join(solution, "image_id").select("object_id", "filter_name", F.radians(ra).alias("a"), F.radians(dec).alias("d"), F.when(F.col("mag_cali_trans").between(-2, 30), F.col("mag_cali_trans")).alias("m"))
    xyz = {"x": F.cos("d") * F.cos("a"), "y": F.cos("d") * F.sin("a"), "z": F.sin("d")}
    mean = placed.groupBy("object_id").agg(*(F.avg(e).alias(k) for k, e in xyz.items()), *(F.avg(F.when(F.col("filter_name") == f, F.col("m"))).alias(f"bright_{f.lower()}") for f in BRIGHTNESS))
    return mean.select("object_id", F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("ra_deg"), F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("dec_deg"), *(f"bright_{f.lower()}" for f in BRIGHTNESS))


def listed_stars(comp_stars: DataFrame) -> DataFrame:
    """One row for each auid, with ``chart_no``: the digits of the chart, in whatever spelling ("CH-313", "ch313", "chart 313")."""
    cols = [c for c in ("ra_deg", "dec_deg", "mag_v", "mag_b", "err_v", "chart") if c in comp_stars.columns]
    one = comp_stars.where("auid IS NOT NULL").groupBy("auid").agg(F.min(F.struct(*cols)).alias("s")).select("auid", "s.*")
    return one.withColumn("chart_no", F.nullif(F.regexp_extract(F.coalesce("chart", F.lit("")), r"(\d+)", 1), F.lit("")))


def candidates(objects: DataFrame, stars: DataFrame, radius: float = RADIUS) -> DataFrame:
    """object_id, auid, shifts in arc seconds (dx, dy) and magnitudes (dv, db), err_v, chart_no and a coarse sky cell."""
    p = sky_pairs(objects, stars, radius)
    dx = (F.pmod(F.col("r.ra_deg") - F.col("l.ra_deg") + 180, F.lit(360.0)) - 180) * F.cos(F.radians(F.col("l.dec_deg"))) * 3600
    return p.select(
        "l.object_id", "r.auid", dx.alias("dx"), ((F.col("r.dec_deg") - F.col("l.dec_deg")) * 3600).alias("dy"),
        (F.col("r.mag_v") - F.col("l.bright_v")).alias("dv"), (F.col("r.mag_b") - F.col("l.bright_b")).alias("db"), "r.err_v", "r.chart_no",
        F.floor(F.col("r.dec_deg")).alias("cell_y"), F.floor(F.col("r.ra_deg") * F.cos(F.radians(F.floor(F.col("r.dec_deg"))))).alias("cell_x"),
    )


def without_chart_shifts(pairs: DataFrame) -> DataFrame:
    """Take the shift of its whole chart from each pair: the median over the chart's pairs of like brightness. A star without a
    chart takes the shift of the chart with most pairs in its part of the sky."""
    alike = pairs.where(F.abs(F.coalesce("dv", "db")) < 0.3)
    shift = [F.percentile_approx(c, 0.5, 1000).alias(f"{c}0") for c in ("dx", "dy", "dv")]
    charts = cut(alike.where("chart_no IS NOT NULL").groupBy("chart_no").agg(*shift))
    around = [F.explode(F.array(*(F.col(c) + k for k in (-1, 0, 1)))).alias(c) for c in ("cell_x", "cell_y")]
    near = alike.where("chart_no IS NOT NULL").groupBy("chart_no", "cell_x", "cell_y").count()
    near = near.select("chart_no", "count", around[0], "cell_y").select("chart_no", "count", "cell_x", around[1])
    by_cell = near.groupBy("cell_x", "cell_y", "chart_no").agg(F.sum("count").alias("n")).groupBy("cell_x", "cell_y").agg(F.max_by("chart_no", F.struct("n", "chart_no")).alias("near_chart"))
    known = pairs.join(by_cell, ["cell_x", "cell_y"], "left").withColumn("chart_no", F.coalesce("chart_no", "near_chart")).drop("near_chart").join(charts, "chart_no", "left")
    return known.withColumns({c: F.col(c) - F.coalesce(f"{c}0", F.lit(0.0)) for c in ("dx", "dy", "dv")}).drop("dx0", "dy0", "dv0", "cell_x", "cell_y")


def _normal(x: Column, spread: Column | float) -> Column:
    s = F.lit(float(spread)) if isinstance(spread, float) else spread
    return F.exp(-0.5 * F.pow(x / s, 2)) / (s * math.sqrt(2 * math.pi))


def evidence(pairs: DataFrame, radius: float = RADIUS) -> DataFrame:
    """object_id, auid, log_odds of each pair from position and brightness alone."""
    alike = pairs.where((F.abs(F.coalesce("dv", "db")) < 0.3) & (F.hypot("dx", "dy") < radius / 2))
    mid = alike.agg(*(F.percentile_approx(F.abs(c), 0.5, 1000).alias(c) for c in ("dx", "dy", "dv"))).first()
    pos = max(0.3, 1.4826 * ((mid["dx"] or 0.5) + (mid["dy"] or 0.5)) / 2)
    mag = max(0.02, 1.4826 * (mid["dv"] or 0.03))
    stars = pairs.select("auid").distinct().count() or 1
    density = max(pairs.where(F.abs("dv") > 1).count() / stars, 0.02) / (math.pi * radius**2)
    # The scatter of positions is not quite normal: a tenth has twice the spread.
    sep2 = F.col("dx") ** 2 + F.col("dy") ** 2
    near = sum(w * F.exp(-sep2 / (2 * s * s)) / (2 * math.pi * s * s) for w, s in ((0.9, pos), (0.1, 2 * pos)))
    odds = F.log(near / density + F.lit(1e-30)) + math.log(PRIOR / (1 - PRIOR))
    for c in ("dv", "db"):
        spread = F.sqrt(F.lit(mag**2) + F.pow(F.coalesce("err_v", F.lit(0.03)), 2))
        like = (1 - ODD) * _normal(F.col(c), spread) + ODD * _normal(F.col(c), ODD_SPREAD)
        odds = odds + F.coalesce(F.log(like / _normal(F.col(c), LOOSE)), F.lit(0.0))
    return pairs.select("object_id", "auid", F.greatest(F.least(odds, F.lit(60.0)), F.lit(-60.0)).alias("log_odds"))


def propagate(pairs: DataFrame, *, price: float = TWICE, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """Marginal probability of each pair (object_id, auid, log_odds): adds ``probability``, and ``unsettled`` where the messages of
    the pair still moved by more than ``still`` after the last round (a warning says how many there are).

    ``to_auid`` is what an object's factor tells a pair, ``to_object`` what a star's factor tells it (both as log odds).
    """
    # A pair meets the sum over its factor in a window: a join with the grouped sums, without a second copy of the pairs.
    star, thing = W.partitionBy("auid"), W.partitionBy("object_id")
    m = cut(pairs.withColumns({"from_object": F.lit(0.0), "from_auid": F.lit(0.0)}))
    for k in range(1, rounds + 1):
        # Odds are bounded at e^25, so that a sum less one of its terms keeps its digits.
        m = m.withColumn("_r", F.exp(F.least(F.col("log_odds") + F.col("from_object"), F.lit(25.0))))
        m = m.withColumn("_new_auid", -F.log1p(F.greatest(F.sum("_r").over(star) - F.col("_r"), F.lit(0.0)))).drop("_r")
        m = m.withColumn("_p", F.log1p(price * F.exp(F.least(F.col("log_odds") + F.col("_new_auid"), F.lit(25.0)))))
        m = m.withColumn("_log_p", F.greatest(F.sum("_p").over(thing) - F.col("_p"), F.lit(0.0)))
        m = m.withColumn("_new_object", F.col("_log_p") - F.log1p(F.expm1("_log_p") / price)).drop("_p", "_log_p")
        half = lambda new, old: (F.col(new) + F.col(old)) / 2
        m = m.withColumns({"_change": F.abs(F.col("_new_object") - F.col("from_object")) + F.abs(F.col("_new_auid") - F.col("from_auid")), "from_object": half("_new_object", "from_object"), "from_auid": half("_new_auid", "from_auid")}).drop("_new_object", "_new_auid")
        if k % 4 == 0 or k == rounds:
            m = cut(m)
            moving = m.where(F.col("_change") >= still).count()
            if not moving:
                break
            if k == rounds:
                warnings.warn(f"{moving} pairs are unsettled after {rounds} rounds of messages", stacklevel=2)
        if k < rounds:
            m = m.drop("_change")
    belief = F.col("log_odds") + F.col("from_object") + F.col("from_auid")
    return m.select("object_id", "auid", "log_odds", (1 / (1 + F.exp(-belief))).alias("probability"), (F.col("_change") >= still).alias("unsettled"))


def match_stars(photometry: DataFrame, wcs: DataFrame, comp_stars: DataFrame) -> DataFrame:
    """object_id, auid, log_odds, probability, unsettled of every candidate pair."""
    pairs = cut(candidates(object_positions(photometry, wcs), listed_stars(comp_stars)))
    return propagate(evidence(cut(without_chart_shifts(pairs))))


def matches_found(photometry: DataFrame, wcs: DataFrame, comp_stars: DataFrame) -> DataFrame:
    """object_id, auid of each match: the most probable object of an auid, if more likely than not."""
    best = match_stars(photometry, wcs, comp_stars).where(F.col("probability") >= MATCH).groupBy("auid")
    return best.agg(F.max_by("object_id", F.struct("probability", -F.col("object_id"))).alias("object_id")).select("object_id", "auid")
