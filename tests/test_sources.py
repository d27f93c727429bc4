from photoloom.sources.catalogues import good_rows, isochrones, votable
from photoloom.sources.sinks import magnitude_lines, write_lines

TABLE = """<VOTABLE xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE><TABLE><FIELD name="ID"/><FIELD name="V"/><FIELD name="FLAG"/><DATA><TABLEDATA>
<TR><TD>a</TD><TD>12.5</TD><TD>0</TD></TR><TR><TD>b</TD><TD></TD><TD>1</TD></TR><TR><TD>c</TD><TD>13</TD><TD/></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"""


def test_votable(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TABLE)
    rows = votable(spark, f"{tmp_path}/a.xml")
    assert [(r.fields["ID"], r.fields["V"]) for r in rows.orderBy("row_no").collect()] == [("a", "12.5"), ("b", None), ("c", "13")]
    assert [r.fields["ID"] for r in good_rows(rows, ["FLAG"]).collect()] == ["a"]


def test_isochrones(spark, tmp_path):
    (tmp_path / "x.iso").write_text("# model\n# Age = 2.5 Gyr\n1 2.0 3\n2 2.5 4\n\n# age 120 Myr\n1 5 6\n")
    got = [(r.iso_id, r.age, r.seq, r.cols) for r in isochrones(spark, f"{tmp_path}/x.iso").orderBy("iso_id", "seq").collect()]
    assert got == [(1, 2.5, 0, [1, 2, 3]), (1, 2.5, 1, [2, 2.5, 4]), (2, 0.12, 0, [1, 5, 6])]


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 12.34567), (2, None)], "i int, m double")
    write_lines(magnitude_lines(df, {"i": "%5d", "m": "%12.3f"}), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["    1       12.346", "    2      999.000"]


def test_parameters_and_catalogue_columns(spark, tmp_path):
    from photoloom.sources.params import catalogue_id, chart_stars, parameters, standard_columns

    (tmp_path / "a.json").write_text('{"fwhm": 4.5, "filters": ["B", "V"]}')
    (tmp_path / "b.yaml").write_text("gain: 2\n")
    (tmp_path / "c.json").write_text("{broken")
    rows = parameters(spark, str(tmp_path)).collect()
    assert {(r.name, r.value) for r in rows if r.name} == {("fwhm", "4.5"), ("filters", '["B", "V"]'), ("gain", "2")}
    assert [r.path[-6:] for r in rows if r.error] == ["c.json"]
    landed = spark.createDataFrame([("1.5", 2.0, 12.0, None)], "RAh string, DEJ2000 double, Vmag double, e_Vmag double")
    r = standard_columns(landed, {"ra": "RAh"}, ra_unit="hourangle").first()
    assert (r.ra_deg, r.dec_deg, r.mag_v, r.err_v, r.mag_b) == (22.5, 2.0, 12.0, None, None)
    assert catalogue_id("APASS") == "II/336/apass9" and catalogue_id("I/305") == "I/305"
    body = '{"photometry": [{"auid": "x", "ra": "1:2:3", "dec": "4", "bands": [{"band": "V", "mag": 12.5, "error": 0.02}, {"band": "Rc", "mag": 11, "error": 0.1}]}]}'
    r = chart_stars(spark.createDataFrame([(body,), ("no json",), (None,)], "body string"), ["V", "R", "B"]).collect()
    assert [(x.auid, x.mag_v, x.err_v, x.mag_r, x.mag_b) for x in r] == [("x", 12.5, 0.02, 11.0, 0.0)]


def test_more_sinks(spark, tmp_path):
    import numpy as np
    import yaml

    from photoloom.sources.fits import read_image
    from photoloom.sources.sinks import fits_documents, region_lines, transform_documents, write_documents, write_light_curves

    assert [r.line for r in region_lines(spark.createDataFrame([(10.5, -3.25), (None, 1.0)], "ra_deg double, dec_deg double")).collect()] == ['circle(10.5000000,-3.2500000,3.000")']
    m = spark.createDataFrame([(7, 1.0, 0.5, 2.0, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0)], "image_id int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    write_documents(transform_documents(m), f"{tmp_path}/t")
    assert yaml.safe_load((tmp_path / "t" / "0000007.yaml").read_text()) == [[1.0, 0.5, 2.0], [0.0, 1.0, -3.0], [0.0, 0.0, 1.0]]
    f = spark.createDataFrame([(3, 2, 2, [1.0, 2.0, 3.0, 4.0], [True, False, False, True])], "image_id int, ny int, nx int, pixels array<double>, mask array<boolean>")
    write_documents(fits_documents(f).union(fits_documents(f, plane="mask")), f"{tmp_path}/f")
    assert np.array_equal(read_image((tmp_path / "f" / "3_pixels.fit").read_bytes())[1], [[1, 2], [3, 4]])
    assert np.array_equal(read_image((tmp_path / "f" / "3_mask.fit").read_bytes())[1], [[1, 0], [0, 1]])
    curve = spark.createDataFrame([(1, "V", 2.5, 12.0, 0.1), (1, "V", 1.5, 12.5, None), (1, "B", 1.0, 13.0, 0.2)], "object_id long, filter_name string, jd double, mag double, mag_err double")
    for how, sep in (("csv", ","), ("dat", " ")):
        write_light_curves(curve, f"{tmp_path}/{how}", how)
        back = spark.read.option("header", "true").option("sep", sep).csv(f"{tmp_path}/{how}").collect()
        assert sorted((r.filter, r.jd, r.mag) for r in back) == [("B", "1.0", "13.0"), ("V", "1.5", "12.5"), ("V", "2.5", "12.0")]
