import math
import random

from photoloom.operators.nearest import mutual_best, nearest_on_axis, unambiguous
from photoloom.operators.spatial import pixel_pairs, sky_pairs


def sep(a, b):
    d1, d2, dr = math.radians(a[2]), math.radians(b[2]), math.radians(b[1] - a[1])
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(dr / 2) ** 2
    return 2 * math.asin(math.sqrt(min(1, h))) * 648000 / math.pi


def test_sky_pairs_with_wrap_and_poles(spark):
    rnd = random.Random(1)
    spots = [(0.001, 10.0), (359.999, 10.0), (123.0, 89.9999), (303.0, 89.9999), (10.0, -89.99995), (200.0, -90.0), (180.0, 0.0)]
    rows = [(i, (ra + rnd.gauss(0, 0.002)) % 360, max(-90.0, min(90.0, dec + rnd.gauss(0, 0.002)))) for i, (ra, dec) in enumerate(spots * 6)]
    a = spark.createDataFrame([*rows, (99, None, 1.0)], "i int, ra_deg double, dec_deg double")
    got = {(r.i, r.j) for r in sky_pairs(a, a.withColumnRenamed("i", "j"), 8.0).select("l.i", "r.j").collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if sep(x, y) <= 8.0}
    spread = {(r.i, r.j) for r in sky_pairs(a, a.withColumnRenamed("i", "j"), 8.0, spread_by="i", ways=3).select("l.i", "r.j").collect()}
    assert spread == got
    assert sky_pairs(a, a, 8.0).count() == len(got) and sky_pairs(a.limit(0), a, 8.0).count() == 0


def test_pixel_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, i % 3, rnd.uniform(-20, 100), rnd.uniform(-20, 100)) for i in range(150)]
    df = spark.createDataFrame([*rows, (999, 0, None, 1.0)], "i int, im int, x double, y double")
    got = sorted((r.a, r.b) for r in pixel_pairs(df, df, 9.0, by=["im"]).selectExpr("l.i a", "r.i b").collect())
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and math.dist(p[2:], q[2:]) <= 9.0)


def test_nearest_on_axis(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice("ab"), rnd.choice([None, float(rnd.randrange(40))])) for i in range(80)]
    right = [(i, rnd.choice("ac"), float(rnd.randrange(40))) for i in range(30)]
    a, b = (spark.createDataFrame(x, "id int, k string, t double") for x in (left, right))
    got = {r.id: r.near_id for r in nearest_on_axis(a, b, ["k"], "t", "id").collect()}
    want = {i: (min(((abs(u - t), u, j) for j, kk, u in right if kk == k), default=(0, 0, None))[2] if t is not None else None) for i, k, t in left}
    assert got == want
    back = {r.id: r.near_t for r in nearest_on_axis(a, b, ["k"], "t", "id", direction="backward").collect()}
    assert back == {i: max((u for _, kk, u in right if kk == k and t is not None and u <= t), default=None) for i, k, t in left}


def test_uniqueness_rules(spark):
    p = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.1), (2, "b", 0.05), (3, "c", 0.2), (4, "c", 0.3)], "x int, y string, d double")
    assert sorted((r.x, r.y) for r in mutual_best(p, ["x"], ["y"], "d").collect()) == [(1, "a"), (2, "b"), (3, "c")]
    q = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (3, "C")], "x int, y string")
    assert sorted((r.x, r.y) for r in unambiguous(q, ["x"], ["y"]).collect()) == [(2, "B"), (3, "C")]
