"""Operators for groups without a bound, against brute force."""

import pytest

from photoloom.operators.clip import sigma_clip_counted
from photoloom.operators.nearest import nearest_on_axis
from photoloom.plans import reference
from tests.test_clip import GROUPS, brute

def test_nearest_looks_beyond_the_period(spark):
    left = spark.createDataFrame([(1, "a", 10.5), (2, "a", 10.9), (3, "a", 14.0), (4, "a", None), (5, "b", 3.0), (6, None, 5.5), (7, "a", 1.0)], "id int, o string, t double")
    right = spark.createDataFrame([(10, "a", 8.0), (11, "a", 8.9), (12, "a", 11.5), (13, "a", 11.5), (14, "a", 16.5), (15, None, 2.0)], "r int, o string, t double")
    got = {x.id: x.near_r for x in nearest_on_axis(left, right, ["o"], "t", "r", period=1.0).collect()}
    assert got == {1: 12, 2: 12, 3: 12, 4: None, 5: None, 6: 15, 7: 10}
    assert got == {x.id: x.near_r for x in nearest_on_axis(left, right, ["o"], "t", "r").collect()}


@pytest.mark.parametrize("how", [{}, {"centre": "mean"}, {"iterations": 1}])
def test_counted_clipping_against_brute_force(spark, how):
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, v in GROUPS.items() for x in v for _ in range(1 + (x == 10))], "g string, x double")
    got = {r.g: (r.n, r.mean, r.median, r["std"]) for r in sigma_clip_counted(df, ["g"], "x", 1.5, **how).collect()}
    want = {g: brute([x for x in v for _ in range(1 + (x == 10))], 1.5, **how) for g, v in GROUPS.items()}
    assert got.keys() == {g for g, w in want.items() if w[0]}
    for g in got:
        assert got[g] == pytest.approx(want[g]), g


def test_mc_samples_has_a_thousand(spark, sf):
    from pyspark.sql import functions as F

    from photoloom.functions.random import normal_sample

    d = spark.read.parquet(f"{sf}/comp_stars.parquet").where("mag_v IS NOT NULL").select("auid", "mag_v", F.coalesce("err_v", F.lit(0.03)).alias("s")).distinct()
    x = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k")).withColumn("x", F.col("mag_v") + F.col("s") * normal_sample(7, F.col("auid"), F.col("k")))
    want = sorted(tuple(w) for w in x.groupBy("auid", "mag_v", "s").agg(F.percentile("x", 0.5), F.stddev_pop("x")).drop("mag_v", "s").collect())
    got = sorted(tuple(g) for g in reference.QUERIES["mc_samples"](spark, sf).collect())
    assert len(got) == len(want) and all(g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=2e-6) for g, w in zip(got, want, strict=True))
