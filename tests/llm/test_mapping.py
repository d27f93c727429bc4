from photoloom.llm.mapping import edit_distance, map_values, mapped_found, pieces, similarity

REF = "ref_id int, field_name string, canonical string, also_known_as string"
ENTRIES = [
    (1, "imagetyp", "Bias Frame", "zero frame"), (2, "imagetyp", "Dark Frame", None), (3, "imagetyp", "Flat Field", "flat frame; dome flat"), (4, "imagetyp", "Light Frame", "science frame; object frame"),
    (5, "imagetyp", "Dark Flat", "dark for flats"), (8, "imagetyp", "Sky Background", "blank sky"),
    (21, "instrume", "Corvane CV-620M", "CV-620 mono"), (22, "instrume", "Corvane CV-620C", None), (24, "instrume", "Helioptic HX-16 Pro", None), (25, "instrume", "Helioptic HX-9", None),
    (28, "instrume", "Brightwell ST-83 CCD Camera", "old west dome camera"), (29, "instrume", "Tamarisk T300 EMCCD", None), (32, "instrume", "Palisade QuadCam", None),
]
CASES = {
    "imagetyp": {"light": 4, "LIGHT_FRAME": 4, "LightFrame #5": 4, "sceince  frame": 4, "objwtframe (30s)": 4, "lofht": 4, "falt": 3, "fllat feild": 3, "darrrk": 2, "DarkFalt": 5, "dark for flats new": 5, "zero": 1, "skybkg": 8, "SKY BCKGROUMD": 8, "frame": 0, "pointing model": 0, "none": 0, "-": 0, "tmp": 0, "Slew": 0},
    "instrume": {"T300": 29, "TamariskT300EMCCD S/N 7913": 29, "Tamarisk T900": 0, "cv  620 c": 22, "CV-620M -20C": 21, "cv620 mnoo": 21, "Corvane CV-640M": 0, "HX  9 [east pier]": 25, "HX16": 24, "Helioptic HX-24": 0, "qudacam": 32, "oldwestdomecamera": 28, "camera 1": 0, "x" * 5000: 0, "a b " * 40: 0},
}


def test_cases(spark):
    rows = [(f, v) for f, c in CASES.items() for v in c]
    got = {(r.field_name, r.value): r.ref_id for r in map_values(spark.createDataFrame(rows * 2, "field_name string, value string"), spark.createDataFrame(ENTRIES, REF)).collect()}
    assert got == {(f, v): k for f, c in CASES.items() for v, k in c.items()}


def test_rows_nulls_repeats_empty(spark):
    frames = spark.createDataFrame([(1, "light", "T300", 0), (1, "light", "T300", 0), (2, "Light Frame", " ", 0), (3, None, "zz9", 0), (None, "light", None, 0)], "image_id int, imagetyp string, instrume string, ref_id int")
    ref = spark.createDataFrame(ENTRIES, REF)
    assert sorted(tuple(r) for r in mapped_found(frames, ref).collect()) == [(1, "imagetyp", 4), (1, "instrume", 29), (3, "instrume", 0)]
    assert mapped_found(frames.limit(0), ref).count() == 0
    assert {r.ref_id for r in mapped_found(frames, ref.limit(0)).collect()} == {0}


def test_distances():
    assert edit_distance("scenec", "science") == 2 and edit_distance("abc", "xyz") == 3 and edit_distance("", "ab") == 2
    assert similarity("cv640m", "cv620m") == 0 and similarity("none", "mono") == 0 and similarity("light", "light") == 1
    assert pieces("TamariskT300EMCCD") == ["tamarisk", "t300", "emccd"] and pieces("nordlys4040") == ["nordlys", "4040"]


def test_long_names_and_values_of_many_pieces(spark):
    long = "Quasiinterferometricspectropolarimeterassemblyunit"
    ref = spark.createDataFrame([*ENTRIES, (40, "instrume", f"{long} Seven", None), (41, "instrume", " ".join(f"word{chr(97 + i)}" for i in range(12)), None)], REF)
    many = {k: "T300 " + "plum gravy jujubes " * k for k in (1, 6, 10, 200)}
    values = [long, long[:10] + "x" + long[11:], long.upper() + " SEVEN", "".join(f"word{chr(97 + i)}" for i in range(12)), "C V 6 2 0 M", *many.values()]
    got = {r.value: r.ref_id for r in map_values(spark.createDataFrame([("instrume", v) for v in values], "field_name string, value string"), ref).collect()}
    assert [got[v] for v in values[:5]] == [40, 40, 40, 41, 21]
    assert [got[v] for v in many.values()] == [29] * 4
