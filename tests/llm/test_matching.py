import itertools
import math
import random

from photoloom.llm.matching import matches_found, propagate

PHOT = "image_id int, object_id long, filter_name string, x_fit double, y_fit double, mag_cali_trans double, ra_deg double"
WCS = "image_id int, crpix1 double, crpix2 double, crval1 double, crval2 double, cd11 double, cd12 double, cd21 double, cd22 double"
COMP = "auid string, ra_deg double, dec_deg double, mag_b double, mag_v double, err_v double, chart string"


def brute(pairs, price):
    """Exact marginals by summing over all sets of matches."""
    total, got = 0.0, dict.fromkeys(((o, a) for o, a, _ in pairs), 0.0)
    for chosen in itertools.product((0, 1), repeat=len(pairs)):
        on = [p for p, c in zip(pairs, chosen, strict=True) if c]
        if len({a for _, a, _ in on}) < len(on):
            continue
        w = math.exp(sum(x for *_, x in on)) * price ** (len(on) - len({o for o, *_ in on}))
        total += w
        for o, a, _ in on:
            got[o, a] += w
    return {k: v / total for k, v in got.items()}


def test_marginals_are_exact_on_trees_and_near_on_loops(spark):
    tree = [(1, "a", 2.0), (1, "b", 1.0), (2, "b", 0.5), (3, "c", -1.0), (4, "d", 40.0), (4, "e", 39.0)]
    loop = [(1, "a", 3.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 2.5)]
    for pairs, room in ((tree, 1e-3), (loop, 0.08)):
        got = {(r.object_id, r.auid): r.probability for r in propagate(spark.createDataFrame(pairs, "object_id long, auid string, log_odds double"), price=0.02).collect()}
        want = brute(pairs, 0.02)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < room for k in got), (got, want)


def scene(seed=4, n=60):
    rnd = random.Random(seed)
    photometry, stars = [], []
    for o in range(n):
        x, y, v = rnd.uniform(50, 2900), rnd.uniform(50, 1900), rnd.uniform(12, 17)
        for image in (1, 2, 3):
            photometry.append((image, o, "V", x + rnd.gauss(0, 0.1), y + rnd.gauss(0, 0.1), v + rnd.gauss(0, 0.02), None))
        dec = 10 - 0.000167 * (y + 1 - 1000.5)
        ra = 359.99 + 0.000167 * (x + 1 - 1500.5) / math.cos(math.radians(dec))
        if o % 3:
            stars.append((f"s{o}", (ra + 1.5 / 3600) % 360 + rnd.gauss(0, 0.0002), dec + rnd.gauss(0, 0.0002), None, v + 0.04 + rnd.gauss(0, 0.02), 0.02, rnd.choice(["CH-7", "ch7", None])))
        if o == 4:
            stars.append(("twice", *stars[-1][1:]))
    stars.append(("alone", 10.0, -60.0, 12.0, 12.0, None, "CH-7"))
    return photometry, stars


def test_scene_with_wrap_shift_and_double_listing(spark):
    photometry, stars = scene()
    wcs = [(i, 1500.5, 1000.5, 359.99, 10.0, 0.000167, 0.0, 0.0, -0.000167) for i in (1, 2, 3)]
    odd = [(1, 900, "V", None, 5.0, 12.0, None), (9, 901, "V", 5.0, 5.0, 12.0, None), (1, None, "V", 5.0, 5.0, 12.0, None)]
    p, w, c = spark.createDataFrame(photometry + odd + photometry[:5], PHOT), spark.createDataFrame(wcs + wcs[:1], WCS), spark.createDataFrame(stars + stars[:2] + [("nowhere", None, 1.0, None, None, None, None), (None, 1.0, 1.0, None, None, None, None)], COMP)
    got = {(r.object_id, r.auid) for r in matches_found(p, w, c).collect()}
    assert got == {(int(s[1:]), s) for s, *_ in stars if s[0] == "s"} | {(4, "twice")}
    assert matches_found(p.limit(0), w, c).count() == 0
    assert matches_found(p, w, c.limit(0)).count() == 0


def test_messages_decide_where_evidence_misleads(spark):
    """By evidence alone star a would go to object 2, which star b claims with far better reason; the messages give it to object 1."""
    pairs = [(1, "a", 2.0), (2, "a", 2.3), (2, "b", 7.0), (3, "c", -40.0)]
    rows = propagate(spark.createDataFrame(pairs, "object_id long, auid string, log_odds double"), price=0.02).collect()
    got = {(r.object_id, r.auid): r.probability for r in rows}
    want = brute(pairs, 0.02)
    assert max((1, 2), key=lambda o: got[o, "a"]) == 1 and got[1, "a"] > 0.5 > got[2, "a"]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)
    assert not any(r.unsettled for r in rows)
