import random

from photoloom.operators.grid import gaps_found, regular_grid

READ = "k string, t double, v double, extra string"


def cells(spark, rows, **kw):
    return {(r.k, r.slot): r for r in regular_grid(spark.createDataFrame(rows, READ), ["k"], "t", "v", **kw).collect()}


def test_increments_are_spread_by_overlap_and_resets_count_from_zero(spark):
    # A grid of 10 cells a day: readings at 0.05, 0.35 (+6), 0.45 (reset, counts 2).
    got = cells(spark, [("a", 0.05, 10.0, "x"), ("a", 0.35, 16.0, "x"), ("a", 0.45, 2.0, "x")], cells_per_day=10, counter="v")
    assert {s: round(r.increment or 0, 6) for (_, s), r in got.items()} == {0: 1.0, 1: 2.0, 2: 2.0, 3: 2.0, 4: 1.0}
    assert [s for (_, s), r in sorted(got.items()) if r.missing] == [1, 2]
    assert round(got["a", 1].filled_value, 6) == round(10 + 6 * (0.15 - 0.05) / 0.3, 6)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randrange(2) + rnd.random() * 0.9, rnd.random(), "x") for k in "abc" for _ in range(25)]
    got = {(k, s) for (k, s), r in cells(spark, rows).items() if r.missing}
    want = set()
    for k in "abc":
        for night in (0, 1):
            have = {int(t * 144) for kk, t, _, _ in rows if kk == k and int(t) == night}
            want |= {(k, s) for s in range(min(have), max(have)) if s not in have}
    assert got == want


def test_nulls_ties_empty(spark):
    rows = [(None, 0.5, 1.0, "x"), (None, 0.5, 1.0, "x"), (None, 0.52, None, "x"), (None, None, 3.0, "x"), ("a", 0.1, float("nan"), "x")]
    got = cells(spark, rows)
    assert list(got) == [(None, 72)] and got[None, 72].n_readings == 2 and not got[None, 72].missing
    assert regular_grid(spark.createDataFrame([], READ), ["k"], "t", "v").count() == 0
    photometry = spark.createDataFrame([], "image_id int, object_id long, filter_name string, mag_cali_trans double")
    frames = spark.createDataFrame([], "image_id int, jd double, date_obs timestamp")
    assert gaps_found(photometry, frames).count() == 0
