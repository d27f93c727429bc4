import numpy as np

from photoloom.operators import spikes
from photoloom.operators.spikes import score_readings, score_sources, spikes_found

PHOT = "image_id int, object_id long, filter_name string, mags_fit double, mag_cali_trans double, mag_cali_no_trans double, extra string"


def tables(spark, rows, n_images=60):
    frames = spark.createDataFrame([(i, 2450000.1 + i / 500, None, "x") for i in range(n_images)] * 2, "image_id int, jd double, date_obs timestamp, extra string")
    return spark.createDataFrame(rows, PHOT), frames


def star(n=60, seed=0, at=lambda i: 0.0):
    rng = np.random.default_rng(seed)
    v = 14 + 0.02 * rng.standard_normal(n)
    return [(i, 7, "V", float(v[i] + at(i) - 24), float(v[i] + at(i)), float(v[i] + at(i) + 0.1), "e") for i in range(n)]


def found(spark, rows):
    return sorted((r.image_id, r.object_id, r.field_name) for r in spikes_found(*tables(spark, rows)).collect())


def test_spikes_limits_and_stuck_runs(spark):
    rows = star()
    rows[10] = (*rows[10][:4], rows[10][4] + 0.5, *rows[10][5:])
    rows[20] = (*rows[20][:5], 99.999, "e")
    rows[30:37] = [(*r[:4], 14.0123, *r[5:]) for r in rows[30:37]]
    rows[45:50] = [(*r[:4], 14.0321, *r[5:]) for r in rows[45:50]]
    want = [(10, 7, "mag_cali_trans"), (20, 7, "mag_cali_no_trans"), *((i, 7, "mag_cali_trans") for i in range(30, 37))]
    assert found(spark, rows + rows[:3] + rows[45:50]) == sorted(want)


def test_real_variability_is_no_case(spark):
    assert found(spark, star(at=lambda i: -0.8 if 25 <= i < 27 else 0.3 * np.sin(i / 6))) == []


def test_nulls_small_series_and_empty(spark):
    rows = [(1, 7, None, None, 14.0, None, "e"), (2, 7, None, None, 19.0, float("nan"), "e"), (None, 7, "V", None, 99.9, 99.9, "e"), (900, 7, "V", None, 999.0, 14.0, "e"), (901, None, "V", None, 999.0, 14.0, "e")]
    assert found(spark, rows) == [(900, 7, "mag_cali_trans")]
    photometry, frames = tables(spark, rows)
    assert spikes_found(photometry.limit(0), frames).count() == 0
    assert score_readings(photometry, frames.limit(0)).count() == 4


def scores(spark, rows, **how):
    return {(r.image_id, r.object_id, r.field_name): (round(r.score, 9), r.spike, r.stuck, r.impossible) for r in score_readings(*tables(spark, rows), **how).collect()}


def test_scores_do_not_depend_on_batches(spark):
    rows = [(i, o, *r[2:]) for o in range(40) for i, r in enumerate(star(seed=o, at=lambda i: 0.4 * (i == 33)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        small = scores(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert small == scores(spark, rows)
    assert len(small) == 40 * 60 * 2 and all(0 < s[0] < 1 for s in small.values())


def many_nights(nights=12, n=300, seed=3):
    """A source with nights of very different length, a faulty reading in each."""
    rng, rows, frames, image = np.random.default_rng(seed), [], [], 0
    for k in range(nights):
        for i in range(n // (1 + k % 3)):
            v = 13 + 0.2 * np.sin(i / 40) + 0.01 * rng.standard_normal() + 0.3 * (i == 50)
            frames.append((image, 2450000.2 + k + i / 3000, None, "x"))
            rows.append((image, 1, "V", float(v - 24 - 0.3 * (i == 50) + 0.01 * rng.standard_normal()), float(v), None, "e"))
            image += 1
    return rows, frames


def test_a_source_spread_over_its_nights_finds_the_same(spark):
    rows, frames = many_nights()
    p, f = spark.createDataFrame(rows, PHOT), spark.createDataFrame(frames, "image_id int, jd double, date_obs timestamp, extra string")
    whole, parts = (score_readings(p, f, plenty=k).toPandas().set_index("image_id").sort_index() for k in (20_000, 500))
    assert len(whole) == len(parts) == len(rows)
    assert whole.index[whole.spike].tolist() == parts.index[parts.spike].tolist() and whole.spike.sum() == 12
    assert abs(whole.score - parts.score).mean() < 0.05 and np.corrcoef(whole.score, parts.score)[0, 1] > 0.9
    # Parts of a source share one forest: the scores of equal parts are equal, whatever else is in the table.
    again = score_readings(p.union(p.withColumn("object_id", p.object_id + 1)), f, plenty=500).where("object_id = 1").toPandas().set_index("image_id").sort_index()
    assert (again.score == parts.score).all()


def test_the_forest_decides(spark, monkeypatch):
    """A source that flickers between levels, further than the exact check asks for: what is usual for it is no case."""
    rng = np.random.default_rng(5)
    restless = [(i, 7, "V", None, float(v), None, "e") for i, v in enumerate(14 + 0.01 * rng.standard_normal(60) + np.where(rng.random(60) < 0.3, 0.12 * rng.choice([-1, 1], 60), 0.0))]
    quiet = star()
    quiet[10] = (*quiet[10][:4], quiet[10][4] + 0.5, *quiet[10][5:])
    rows = [*restless, *((i, 8, *r[2:]) for i, r in enumerate(quiet))]
    with_forest = {k for k in found(spark, rows) if k[1] == 7}
    assert (10, 8, "mag_cali_trans") in found(spark, rows)
    monkeypatch.setattr(spikes, "OUTSTANDING", -1e9)
    everything = {k for k in scores_off(rows) if k[1] == 7}
    assert with_forest < everything and len(everything) > len(with_forest) + 2


def scores_off(rows):
    """The rows found in this process, where a changed threshold is seen."""
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["image_id", "object_id", "filter_name", "fit", "mag_cali_trans", "mag_cali_no_trans", "extra"]).drop_duplicates()
    pdf = pdf.assign(jd=2450000.1 + pdf.image_id / 500, night=2450000, part=0).sort_values(["object_id", "image_id"])
    got = pd.concat(spikes._work(["mag_cali_trans", "mag_cali_no_trans"])([pdf]))
    return {(r.image_id, r.object_id, r.field_name) for r in got[got.spike].itertuples()}


def test_a_large_source_is_learned_from_a_subsample():
    rng = np.random.default_rng(1)
    v = 12 + 0.01 * rng.standard_normal(5000)
    v[777] += 1.0
    zero = np.zeros(5000, int)
    got = score_sources(v, np.full(5000, np.nan), zero, zero, zero, np.array([5]), np.arange(5000))
    assert got["spike"].nonzero()[0].tolist() == [777]
    assert got["score"][777] == got["score"].max()


def exact(spark, rows, frames, **how):
    p, f = spark.createDataFrame(rows, PHOT), spark.createDataFrame(frames, "image_id int, jd double, date_obs timestamp, extra string")
    return sorted(map(repr, score_readings(p, f, **how).collect()))


def test_the_layout_changes_no_result(spark):
    """Whole or in chunks, a source has the same scores to the last bit, repeated rows and all kinds of filters and values too."""
    rows, frames = many_nights(nights=5, n=600)
    rows = [(i, o, f, fit, v, v + 0.1 * (i % 7 > 2), e) for i, o, f, fit, v, _, e in rows]
    rows[40:47] = [(*r[:4], 13.0123, *r[5:]) for r in rows[40:47]]
    rows[90] = (*rows[90][:4], float("nan"), 99.0, "e")
    rows += [(*r[:4], r[4] + 0.2, r[5] - 0.2, "again") for r in rows[::50]]
    rows += [(i, o, f, fit, v, w, e) for i, o, _, fit, v, w, e in rows[:400] for f in (None, "")]
    # A source without any reading that could be learned from, and images without a time.
    rows += [(i, 2, "V", None, 99.0, None, "e") for i in range(200)] + [(10**6 + i, 1, "V", None, 13.0, 99.0, "e") for i in range(3)]
    whole = exact(spark, rows, frames, plenty=10**6)
    assert len(whole) == len(set(whole)) > 5000
    assert whole == exact(spark, rows, frames, plenty=300) == exact(spark, rows, frames, plenty=1100)


def test_the_size_of_the_table_changes_no_result(spark, monkeypatch):
    """The bound rises with the rows of the table; what a source shows does not."""
    rows, frames = many_nights(nights=4, n=600)
    others = [(r[0], o, *r[2:]) for o in range(10, 20) for r in rows[:300]]
    monkeypatch.setattr(spikes, "MOST_PLENTIFUL", 2)
    alone, among = (exact(spark, t, frames, plenty=200) for t in (rows, rows + others))
    assert alone == [r for r in among if "object_id=1," in r]


def test_scores_do_not_depend_on_the_other_sources():
    rng = np.random.default_rng(2)
    v = 12 + 0.01 * rng.standard_normal(420)
    v[5] += 0.5
    source = np.repeat([0, 1], [20, 400])
    both = score_sources(v, np.full(420, np.nan), np.zeros(420, int), source, source, np.array([5, 6]), np.arange(420))
    for k in (0, 1):
        m = source == k
        zero = np.zeros(m.sum(), int)
        one = score_sources(v[m], np.full(m.sum(), np.nan), zero, zero, zero, np.array([5 + k]), np.arange(420)[m])
        assert all((one[c] == both[c][m]).all() for c in one)


def test_an_image_counts_once_in_each_filter(spark):
    rows = [(1, 7, f, None, 99.0, None, "e") for f in ("B", "V", None, "")] * 2
    got = score_readings(*tables(spark, rows)).collect()
    assert sorted(repr(r.filter_name) for r in got) == ["''", "'B'", "'V'", "None"]


def test_medians_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {0: [0.25], 1: [3.0, 1.0], 2: [2.0] * 9 + [5.0] * 9, 3: rng.normal(14, 0.3, 1001).tolist(), 4: np.round(rng.normal(14, 1e-5, 1000), 6).tolist(), 5: [-1.5, 29.0, 3.0, 3.00001]}
    df = spark.createDataFrame([(k, v) for k, g in groups.items() for v in g], "k int, v double")
    got = {r.k: (r["size"], r.m) for r in spikes._medians(df, ["k"], "v", "m").collect()}
    assert got == {k: (len(g), float(np.median(g))) for k, g in groups.items()}
