import numpy as np
import pytest

from photoloom.operators.clip import sigma_clip_flags, sigma_clip_large, sigma_clip_stats


def brute(v, k, iterations=5, centre="median", spread="std"):
    v = np.array([x for x in v if x is not None and x == x], float)
    for _ in range(iterations):
        if not len(v):
            break
        m = np.median(v) if centre == "median" else v.mean()
        s = v.std() if spread == "std" else 1.482602218505602 * np.median(np.abs(v - m))
        v = v[(v >= m - k * s) & (v <= m + k * s)]
    return (len(v), *((v.mean(), np.median(v), v.std()) if len(v) else (None, None, None)))


GROUPS = {"a": [10.0, 10, 11, 9, 10, 50], "b": [1.0, 2], "c": [5.0], "d": [3.0, 3, 3], "e": [None, float("nan")], None: [1.0, None, 2, 2, 2, 90, 2.5]}
GROUPS |= {f"r{i}": list(np.random.default_rng(i).standard_t(2, 60)) for i in range(5)}


@pytest.mark.parametrize("how", [{}, {"centre": "mean"}, {"spread": "mad"}, {"iterations": 1}])
def test_against_brute_force(spark, how):
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, v in GROUPS.items() for x in v], "g string, x double")
    got = {r.g: (r.n, r.mean, r.median, r["std"]) for r in sigma_clip_stats(df, ["g"], "x", 1.5, **how).collect()}
    assert got.keys() == GROUPS.keys()
    for g, v in GROUPS.items():
        assert got[g] == pytest.approx(brute(v, 1.5, **how)), g


def test_flags_large_groups_and_empty(spark):
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, v in GROUPS.items() for x in v], "g string, x double")
    flags = sigma_clip_flags(df, ["g"], "x", 1.5)
    assert flags.count() == df.count() and flags.where("g = 'a' AND clipped").count() == 3
    large = {r.g: r.n for r in sigma_clip_large(df, ["g"], "x", 3.0).collect()}
    assert large["a"] == brute(GROUPS["a"], 3.0)[0] and large["r1"] == pytest.approx(brute(GROUPS["r1"], 3.0)[0], abs=2)
    assert sigma_clip_stats(df.limit(0), ["g"], "x", 1.5).count() == 0
