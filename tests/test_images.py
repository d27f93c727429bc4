import numpy as np
import pytest

from photoloom.images import kernels as K
from photoloom.images.frames import combine, extract, shifts
from photoloom.sources.fits import headers, images, parse_card, read_image, write_image

STARS = [(20.3, 15.7, 4000.0), (44.0, 40.2, 9000.0), (12.5, 48.1, 2500.0)]


def scene(seed=0, dy=0, dx=0, stars=STARS):
    rng = np.random.default_rng(seed)
    jj, ii = np.mgrid[:64, :64]
    out = 100 + rng.standard_normal((64, 64)) * 2
    for x, y, f in stars:
        out += f / (2 * np.pi * 1.7**2) * np.exp(-((ii - x - dx) ** 2 + (jj - y - dy) ** 2) / (2 * 1.7**2))
    return out


def test_find_and_measure():
    image = scene()
    found = K.find_stars(image)
    assert len(found) == 3
    for x, y, f in STARS:
        k = np.hypot(found[:, 0] - x, found[:, 1] - y).argmin()
        assert np.hypot(found[k, 0] - x, found[k, 1] - y) < 0.3
        flux, err, sky = K.aperture_photometry(image, found[k : k + 1, 0], found[k : k + 1, 1], 6, 8, 12)[0]
        assert flux == pytest.approx(f, rel=0.05) and sky == pytest.approx(100, abs=1) and 0 < err < 0.1 * f


def test_alignment_stack_and_reduction():
    assert K.shift_between(scene(1), scene(2, dy=3, dx=-2)) == (-3, 2)
    moved = K.shifted(scene(1), 2.0, 1.0)
    assert np.allclose(moved[2:, 1:], scene(1)[:-2, :-1]) and np.isnan(moved[:2]).all()
    cube = np.stack([scene(i) for i in range(9)])
    cube[4, 30, 30] += 5000
    assert abs(K.stack(cube)[30, 30] - 100) < 4
    bias, dark, flat = np.full((4, 4), 10.0), np.full((4, 4), 30.0), np.linspace(0.8, 1.2, 16).reshape(4, 4)
    raw = 10 + (dark - 10) * 2 + 500 * flat
    assert np.allclose(K.reduce_frame(raw, 20, bias, dark, 10, flat), 500)
    assert K.hot_pixels(np.r_[np.zeros(96), 50, 50, 50, 200].reshape(10, 10)) [1] == 50
    assert K.block_average(np.arange(16.0).reshape(4, 4), 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert K.pad(np.ones((2, 2)), 3, 4).sum() == 4 and K.flip(np.array([[1, 2], [3, 4]])).tolist() == [[4, 3], [2, 1]]
    assert K.trim(np.ones((5, 6)), 1, 2, 1, 0).shape == (4, 3) and K.deviation(np.array([100.0]), 2.0, 5.0)[0] == pytest.approx(7.5)


def test_cosmic_rays():
    image = scene()
    image[30, 33] += 800
    image[51, 20] += 600
    mask = K.cosmic_rays(image, 2.0)
    assert mask[30, 33] and mask[51, 20] and mask.sum() <= 4
    assert abs(K.clean(image, mask)[30, 33] - 100) < 6


def test_fits_round_trip_and_sources(spark, tmp_path):
    image = scene()
    image[0, 0] = np.nan
    header, back = read_image(write_image(image, {"OBJECT": "it's", "EXPTIME": 45.0, "COMBINED": True}))
    assert np.array_equal(back, image, equal_nan=True) and header["OBJECT"] == "it's" and header["COMBINED"] == "true"
    assert parse_card("GAIN    =                 56 / comment".ljust(80)) == ("GAIN", "56") and parse_card("COMMENT x".ljust(80)) is None
    for i in range(3):
        (tmp_path / f"{i}_a.FIT").write_bytes(write_image(scene(i, dy=i), {"EXPTIME": 10.0 * i, "FILTER": "V"}))
    (tmp_path / "bad.fits").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    h = headers(spark, str(tmp_path)).collect()
    assert len(h) == 4 and sum(r.error is not None for r in h) == 1
    (tmp_path / "bad.fits").unlink()
    df = images(spark, str(tmp_path)).selectExpr("cast(header['EXPTIME'] as double) / 10 image_id", "header['FILTER'] f", "ny", "nx", "pixels")
    assert extract(df).groupBy("image_id").count().where("count = 3").count() == 3
    assert {int(r.image_id): r.dy for r in shifts(df, scene(0)).collect()} == {0: 0, 1: -1, 2: -2}
    master = combine(df, ["f"], "median").first()
    assert (master.n, master.ny, len(master.pixels)) == (3, 64, 64 * 64)


def test_psf_photometry_of_overlapping_stars():
    pair = [(30.0, 30.0, 6000.0), (34.5, 31.0, 3000.0), (12.3, 50.4, 5000.0), (50.0, 12.6, 8000.0)]
    image = scene(5, stars=pair) - 100
    psf = K.empirical_psf(image, np.array([12.3, 50.0]), np.array([50.4, 12.6]), 7)
    x, y, f = (np.array(v) for v in zip(*pair, strict=True))
    got, residual = K.psf_photometry(image, x + 0.3, y - 0.2, psf, 2.0)
    assert got[:, 2] == pytest.approx(f, rel=0.06)
    assert np.hypot(got[:, 0] - x, got[:, 1] - y).max() < 0.25 and residual.std() < 0.2 * image.std()


def test_similarity_transform():
    rng = np.random.default_rng(3)
    ref = np.c_[rng.uniform(0, 1000, (25, 2)), rng.uniform(1, 9, 25)]
    turn, scale, shift = 0.4, 1.1, np.array([30.0, -12.0])
    m = scale * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    moved = np.c_[(ref[:, :2] - shift) @ np.linalg.inv(m).T + rng.normal(0, 0.2, (25, 2)), ref[:, 2]][3:]
    got = K.similarity_transform(ref, np.r_[moved, [[5.0, 5.0, 8.0]]])
    assert np.allclose(got, np.c_[m, shift], atol=1.0) and np.allclose(got[:, :2], m, atol=0.005)
    assert K.similarity_transform(ref[:2], moved) is None


def test_reduction_of_frames(spark):
    from photoloom.images.frames import combine_by_pixel, limits
    from photoloom.images.frames import reduce as reduce_frames

    n = 32
    bias, dark, flat = np.full((n, n), 100.0), np.full((n, n), 101.0), np.linspace(0.8, 1.2, n * n).reshape(n, n)
    dark[4, 4] = 400.0
    flat = flat / flat.mean()
    raw = 100 + 2 * (dark - 100) + 500 * flat
    raw[20, 21] += 4000
    raw[9, 9] = 10
    frame = "image_id int, exptime double, ny int, nx int, pixels array<double>, bias_id int, dark_id int, flat_id int"
    frames = spark.createDataFrame([(1, 20.0, n, n, raw.ravel().tolist(), 10, 11, 12), (2, 20.0, n, n, raw.ravel().tolist(), None, None, None), (3, 1.0, n, n, None, 10, 11, 12)], frame)
    masters = spark.createDataFrame([(10, 0.0, bias.ravel().tolist()), (11, 10.0, dark.ravel().tolist()), (12, 1.0, flat.ravel().tolist())], "master_id int, exptime double, pixels array<double>")
    got = {r.image_id: r for r in reduce_frames(frames, masters).collect()}
    assert sorted(got) == [1, 2]
    out, mask = np.array(got[1].pixels).reshape(n, n), np.array(got[1].mask).reshape(n, n)
    assert np.allclose(out[12:18, 12:18], 25.0) and abs(out[20, 21] - 25.0) < 1.0
    assert mask[4, 4] and mask[9, 9] and mask.sum() == 2
    groups = spark.createDataFrame([(k % 2, n, n, (raw + k).ravel().tolist()) for k in range(8)], "g int, ny int, nx int, pixels array<double>")
    whole = {r.g: np.array(r.pixels) for r in combine(groups, ["g"]).collect()}
    tiles = combine_by_pixel(groups, ["g"], tile=300).orderBy("g", "tile").collect()
    for g in (0, 1):
        assert np.allclose(np.concatenate([r.pixels for r in tiles if r.g == g]), whole[g])
    sky = scene()
    lim = limits(spark.createDataFrame([(1, 64, 64, sky.ravel().tolist(), 25.0)], "image_id int, ny int, nx int, pixels array<double>, zp double"), radius=2.0).first()
    assert 20 < lim.flux_limit < 80 and lim.mag_limit == pytest.approx(25 - 2.5 * np.log10(lim.flux_limit))


def test_shift_within_a_window_and_masks():
    assert K.limited_shift(scene(1), scene(2, dy=3, dx=-2), 10) == (-3, 2)
    dy, dx = K.limited_shift(scene(1), scene(2, dy=9, dx=0), 5)
    assert abs(dy) <= 5 and abs(dx) <= 5
    image, mask, error = K.pad_masked(np.ones((2, 2)), np.zeros((2, 2), bool), np.ones((2, 2)), 3, 3)
    assert image.sum() == 4 and mask.sum() == 5 and error.sum() == 4
    flat = np.ones((20, 20)) + np.random.default_rng(0).normal(0, 0.01, (20, 20))
    flat[5, 6] = 0.3
    assert K.plain_mask(flat)[5, 6] and K.plain_mask(flat).sum() < 5
    assert np.isnan(K.limiting_flux(np.ones((9, 9)), np.ones((9, 9), bool), 2.0))


def test_a_bad_file_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "1.fit").write_bytes(write_image(scene()))
    (tmp_path / "2.fit").write_bytes(b"no such thing")
    got = {r.path[-5:]: r for r in images(spark, str(tmp_path)).collect()}
    assert got["1.fit"].ny == 64 and got["1.fit"].error is None
    assert got["2.fit"].pixels is None and got["2.fit"].error
