from photoloom.operators.units import harmonise_angles, positions_found, units_inferred

SCHEMA = "cal_id long, catalog_code string, ra_text string, dec_text string, ra_unit string, dec_unit string, remark string, extra string"
INFO = "catalog_code string, title string, ra_unit string, dec_unit string, note string"
CATALOGUES = [("A", "a", "deg", "deg", None), ("N", "n", None, None, "Right ascensions are printed in hours of time, declinations in degrees."), ("W", "w", None, None, "All angles in arc minutes unless a row says otherwise.")]


def found(spark, rows):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA)
    return {r.cal_id: (r.ra_arcsec, r.dec_arcsec) for r in positions_found(df, spark.createDataFrame(CATALOGUES, INFO)).collect()}


CASES = [
    (("A", "10.5", "-0.5", None, None, None), (37800, -1800)),
    (("A", " 10,5 ", "−0,5", None, None, "checked"), (37800, -1800)),
    (("A", "01:00:00.4", "-0:00:05", "h", None, None), (54006, -5)),
    (("A", "01:00:00", "+1 00 00", None, None, None), (3600, 3600)),
    (("A", "01h00m00s", "1° 0′ 0″", "deg", "rad", None), (54000, 3600)),
    (("A", "1 deg 00 min 01 sec", "60 '", None, None, "RA in hours, Dec in rad"), (3601, 3600)),
    (("A", "3600000mas", "3600 \"", "h", None, None), (3600, 3600)),
    (("A", "1", "1", None, None, "coords RA hours of time / DE arc minutes; see log"), (54000, 60)),
    (("N", "1", "1", None, None, None), (54000, 3600)),
    (("W", "1", "1", None, None, None), (60, 60)),
    (("W", "1", "1", "Deg.", "as", None), (3600, 1)),
    (("A", "1e2", "3.14159265358979 rad", None, None, None), None),
    (("A", "360", "0", None, None, None), None),
    (("A", "24.5", "0", "h", None, None), None),
    (("A", "n/a", "0", None, None, None), None),
    (("A", None, "", None, None, None), None),
    (("A", "10:61:00", "0", None, None, None), None),
    ((None, "10", "10", "deg", "deg", None), (36000, 36000)),
]


def test_cases(spark):
    got = found(spark, [row for row, _ in CASES])
    assert [(row, got.get(i)) for i, (row, _) in enumerate(CASES)] == CASES


def test_repeated_rows_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "A", "1", "1", None, None, None, "x")] * 3 + [(2, "A", "9" * 5000 + "x", "1", None, None, "r" * 5000, "x"), (None, "A", "1", "1", None, None, None, "x")], SCHEMA)
    assert [tuple(r) for r in positions_found(df, spark.createDataFrame(CATALOGUES, INFO)).collect()] == [(1, 3600, 3600)]
    assert harmonise_angles(df.limit(0), spark.createDataFrame(CATALOGUES, INFO)).count() == 0
    assert harmonise_angles(df).where("cal_id = 1").select("extra", "ra_unit_from").distinct().count() == 1


def test_missing_units_are_inferred(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for i in range(900):
        ra, dec = rnd.uniform(0, 360), rnd.uniform(-80, 80)
        code = ("A", "lost mas", "lost rad")[i % 3]
        f = {"A": 1, "lost mas": 3.6e6, "lost rad": 0.017453292519943295}[code]
        rows.append((i, code, f"{ra * f:.6f}", f"{dec * f:.6f}", None, None, None, "x"))
    out = harmonise_angles(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(CATALOGUES, INFO)).where("ra_unit_from = 'inferred'").collect()
    assert len(out) == 600
    right = [r.ra_used == r.catalog_code.split()[1] for r in out]
    assert sum(right) > 0.98 * len(out)
    assert all(r.ra_posterior >= 0.9 or r.ra_uncertain for r in out)


def test_robbed_rows_of_the_given_tables_are_mostly_right(spark, sf):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("calib", "catalog_info")]
    out = units_inferred(*tables).collect()
    sure = [r for r in out if not r.uncertain]
    assert len(out) > 50 and len(sure) > 20
    assert sum(r.unit == r.stated for r in sure) >= 0.9 * len(sure)
