"""Quantities recorded in different units (problem 1).

``harmonise_angles`` turns pairs of angle texts into degrees.  For each coordinate the unit comes from, in this order, marks
in the text itself, the row's unit column, the row's remark, the catalogue's unit column, the catalogue's note.  Where none
of these speaks, the unit is inferred: in the logarithm of the printed value, every unit is the same density of true angles
shifted by a known offset (the log of the conversion factor), so the values of a catalogue are a mixture of shifted copies of
one shape.  The shape is the density of all values with a stated unit; the weights of a catalogue are fitted by EM on binned
counts; a value gets the unit of the highest posterior and its posterior is reported.

Defined results
---------------
* null, empty, blank or unreadable text ("n/a", "--"): degrees null, ``unit_from`` null.
* three numbers are sexagesimal in their unit, with minutes and seconds below 60, else unreadable; "-0:00:05" keeps its sign.
* a decimal comma is a decimal point; typographic minus, primes and superscript h, m, s are read as their plain forms.
* exact repeats of a row stay repeats; the caller decides (``positions_found`` gives one row for each key).
* columns that are not used pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoloom.functions.text import tidy
from photoloom.session import cut

#: Degrees in one unit.
DEGREES_PER = {"deg": 1.0, "hour": 15.0, "arcmin": 1 / 60, "arcsec": 1 / 3600, "mas": 1 / 3_600_000, "rad": 180 / math.pi}

#: Names of each unit in lower case without blanks and full stops (fixed values).
UNIT_NAMES = {
    "mas": ("mas", "milliarcsec", "milliarcsecs", "milliarcsecond", "milliarcseconds"),
    "arcsec": ("arcsec", "arcsecs", "arcsecond", "arcseconds", "secondofarc", "secondsofarc", "as", "''", '"'),
    "arcmin": ("arcmin", "arcmins", "arcminute", "arcminutes", "minuteofarc", "minutesofarc", "am", "'"),
    "hour": ("hour", "hours", "hr", "hrs", "h", "hms", "hourangle", "hourangles", "houroftime", "hoursoftime", "hrsoftime"),
    "deg": ("deg", "degs", "degree", "degrees", "d", "dms", "\u00b0"),
    "rad": ("rad", "rads", "radian", "radians"),
}


def _names(*units: str) -> str:
    """A pattern of the units' names, with blanks allowed where words join; longer names come before their beginnings."""
    names = sorted((n for u in units for n in UNIT_NAMES[u]), key=len, reverse=True)
    return "|".join(re.sub(r"^(milli|arc|hour|hrs|seconds?|minutes?)(?=arc|sec|min|angle|of)|(?<=milli)arc(?=sec)|(?<=[a-z])of(?=arc|time)", lambda m: m[0] + " ?" if m.start() == 0 or m[0] == "arc" else " ?" + m[0] + " ?", n) for n in names)


ANY_UNIT = _names(*UNIT_NAMES)

_NUMBER = r"(\d+(?:\.\d*)?|\.\d+)(?:e([+-]?\d{1,3}))?"
PLAIN = rf"^([+-]?) ?{_NUMBER} ?({ANY_UNIT})?\.?$"
FIRST_MARK = rf"(?: ?(:|{_names('hour', 'deg')}) ?| )"
SEXAGESIMAL = rf"^([+-]?) ?(\d{{1,12}}){FIRST_MARK}(\d{{1,2}})(?: ?(?::|m|min(?:ute)?s?|') ?| )(\d{{1,2}}(?:\.\d*)?) ?(?:s|sec(?:ond)?s?|\"|'')? ?({ANY_UNIT})?\.?$"

INFERRED = "axis string, catalogue string, bin int, inferred string, posterior double"
#: Width of a bin of log10(value), and the range of bins.
BIN, LOW, HIGH = 0.05, -6.0, 12.0
#: A value whose best unit has less than this posterior is flagged.
SURE = 0.9


def canonical_unit(text: Column) -> Column:
    """The unit a text names as a whole ("Arcmin", "hrs", "Deg."), or null."""
    known = F.create_map(*(F.lit(x) for u, names in UNIT_NAMES.items() for n in names for x in (n, u)))
    return F.try_element_at(known, F.regexp_replace(F.lower(tidy(text)), r"[ .]", ""))


def _said(text: Column, axis: str) -> Column:
    """The unit that a free text in ``tidy`` lower case (a remark, a catalogue's note) states for an axis, or for both axes."""
    names = {"ra": r"right ascensions?|r\.?a\.?|alpha", "dec": r"declinations?|dec?l?\.?|delta"}[axis]
    t = text
    own = rf"(?:^|[^a-z])(?:{names})(?: (?:is|are|was|were))?(?: printed| given| measured)?(?: in|:|=)? ?({ANY_UNIT})(?![a-z])"
    both = rf"(?:all|both) (?:angles|coordinates|positions)(?: are| were)?(?: printed| given)? in ({ANY_UNIT})(?![a-z])"
    both_after = rf"(?:^|[^a-z])({ANY_UNIT}) for (?:both|all) (?:coordinates|angles|positions)"
    return canonical_unit(F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in (own, both, both_after))))


def read_angles(df: DataFrame, *texts: str) -> DataFrame:
    """For each text column ``x`` the columns ``_x_value`` (the number in its own unit, with its sign; null where the text is
    unreadable) and ``_x_mark`` (the unit that marks in the text state, or null)."""
    df = df.withColumns({f"_{x}_t": F.regexp_replace(F.lower(tidy(F.col(x))), r"(\d),(\d)", "$1.$2") for x in texts})
    # One array of parts for either form: sign, first number, exponent, minutes, seconds, marks.
    forms = ((PLAIN, "$1|$2|$3|||$4||"), (SEXAGESIMAL, "$1|$2||$4|$5|$3|$6|"))
    df = df.withColumns({f"_{x}_p": F.split(F.coalesce(*(F.when(F.col(f"_{x}_t").rlike(p), F.regexp_replace(f"_{x}_t", p, to)) for p, to in forms)), r"\|") for x in texts})

    def value(x: str) -> Column:
        p = F.col(f"_{x}_p")
        first, ten, m, s = (p[i].try_cast("double") for i in (1, 2, 3, 4))
        whole = F.when(p[3] == "", first * F.coalesce(F.pow(F.lit(10.0), ten), F.lit(1.0))).when((m < 60) & (s < 60), first + m / 60 + s / 3600)
        return F.when(p[0] == "-", -whole).otherwise(whole)

    marks = {f"_{x}_mark": canonical_unit(F.when(F.col(f"_{x}_p")[5].isin("", ":"), F.col(f"_{x}_p")[6]).otherwise(F.col(f"_{x}_p")[5])) for x in texts}
    return df.withColumns({f"_{x}_value": value(x) for x in texts} | marks).drop(*(f"_{x}_{k}" for x in texts for k in "tp"))


def to_degrees(value: Column, unit: Column) -> Column:
    factor = reduce(lambda rest, u: F.when(unit == u, F.lit(DEGREES_PER[u])).otherwise(rest), DEGREES_PER, F.lit(None).cast("double"))
    return value * factor


def _bin(value: Column) -> Column:
    return F.floor(F.least(F.greatest(F.log10(F.abs(value)), F.lit(LOW)), F.lit(HIGH)) / BIN).cast("int")


def _em(counts: np.ndarray, like: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of the components of a mixture with known likelihoods (bins x units), over binned counts."""
    w = np.full(like.shape[1], 1.0 / like.shape[1])
    for _ in range(rounds):
        joint = like * w
        post = joint / joint.sum(axis=1, keepdims=True)
        new = (counts @ post + 0.1) / (counts.sum() + 0.1 * len(w))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _fit(shape: dict[int, float]):
    """A function that fits one (axis, catalogue) group of binned values: its size is bounded by the number of bins."""
    units = list(DEGREES_PER)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        axis, catalogue = pdf["axis"].iloc[0], pdf["catalogue"].iloc[0]
        dense = np.array([shape.get((axis, b), 0.0) for b in range(int(LOW / BIN) - 160, int(HIGH / BIN) + 161)]) + 1e-9
        dense /= dense.sum()
        bins = pdf["bin"].to_numpy(int)
        like = np.stack([dense[np.clip(bins + round(math.log10(f) / BIN) - int(LOW / BIN) + 160, 0, len(dense) - 1)] for f in DEGREES_PER.values()], axis=1)
        stated = pdf["stated"].to_numpy(object)
        free = np.array([s is None for s in stated])
        like = np.where(free[:, None], like, np.array([[1.0 if u == s else 1e-12 for u in units] for s in stated]))
        w = _em(pdf["n"].to_numpy(float), like)
        joint = like * w
        post = joint / joint.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        out = pd.DataFrame({"axis": axis, "catalogue": catalogue, "bin": bins, "inferred": [units[i] for i in best], "posterior": post[np.arange(len(bins)), best]})
        return out[free]

    return fit


def infer_units(long: DataFrame) -> DataFrame:
    """(axis, catalogue, bin) -> inferred, posterior, for the values in ``long`` (axis, catalogue, value, stated) without a stated unit.

    Values without a unit are rare or absent in a well-kept table; then the fit runs over nothing. The counts are binned before
    anything is shuffled; the shape that is shipped to the tasks has at most (HIGH - LOW) / BIN bins for each axis.
    """
    used = long.where(F.col("value").isNotNull() & (F.col("value") != 0))
    true = F.when(F.col("stated").isNotNull(), _bin(to_degrees(F.col("value"), F.col("stated")))).alias("true")
    binned = cut(used.groupBy("axis", "catalogue", "stated", _bin(F.col("value")).alias("bin"), true).agg(F.count("*").alias("n")))
    if binned.where(F.col("stated").isNull()).isEmpty():
        return binned.sparkSession.createDataFrame([], INFERRED)
    shape = {(r["axis"], r["true"]): float(r["n"]) for r in binned.where(F.col("true").isNotNull()).groupBy("axis", "true").agg(F.sum("n").alias("n")).collect()}
    binned = binned.groupBy("axis", "catalogue", "stated", "bin").agg(F.sum("n").alias("n"))
    return binned.groupBy("axis", "catalogue").applyInPandas(_fit(shape), INFERRED)


def harmonise_angles(calib: DataFrame, catalogues: DataFrame | None = None, *, key: str = "cal_id", catalogue: str = "catalog_code") -> DataFrame:
    """``calib`` with, for each of ra and dec: ``<axis>_deg``, ``<axis>_used`` (unit), ``<axis>_unit_from`` (text, column, remark,
    catalogue, note or inferred), ``<axis>_posterior`` (1.0 where the unit is stated) and ``<axis>_uncertain``."""
    df = calib
    if catalogues is not None:
        info = catalogues.groupBy(F.col(catalogue).alias("_code")).agg(*(F.first(c, ignorenulls=True).alias(f"_cat_{c}") for c in ("ra_unit", "dec_unit", "note")))
        df = df.join(info, df[catalogue] == F.col("_code"), "left").drop("_code")
    else:
        df = df.withColumns({f"_cat_{c}": F.lit(None).cast("string") for c in ("ra_unit", "dec_unit", "note")})
    df = read_angles(df, "ra_text", "dec_text").withColumns({"_remark": F.lower(tidy(F.col("remark"))), "_note": F.lower(tidy(F.col("_cat_note")))})
    sources = ("text", "column", "remark", "catalogue", "note")
    df = df.withColumns({
        f"_{a}_{k}": u
        for a in ("ra", "dec")
        for k, u in zip(sources, (F.col(f"_{a}_text_mark"), canonical_unit(F.col(f"{a}_unit")), _said(F.col("_remark"), a), canonical_unit(F.col(f"_cat_{a}_unit")), _said(F.col("_note"), a)), strict=True)
    })
    df = df.withColumns({f"_{a}_said": F.coalesce(*(F.col(f"_{a}_{k}") for k in sources)) for a in ("ra", "dec")} | {f"_{a}_from": F.coalesce(*(F.when(F.col(f"_{a}_{k}").isNotNull(), F.lit(k)) for k in sources)) for a in ("ra", "dec")})
    # The texts are read once; the bins of the mixture and the answer both go on from what was read.
    df = cut(df.select(*calib.columns, *(f"_{a}_{k}" for a in ("ra", "dec") for k in ("text_value", "said", "from"))))
    name = F.coalesce(F.col(catalogue), F.lit(""))
    missing = {a: F.col(f"_{a}_said").isNull() & F.col(f"_{a}_text_value").isNotNull() for a in ("ra", "dec")}
    if df.where(missing["ra"] | missing["dec"]).isEmpty():
        df = df.withColumns({f"_{a}_{k}": F.lit(None).cast(t) for a in ("ra", "dec") for k, t in (("inferred", "string"), ("post", "double"))})
    else:
        both = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"_{a}_text_value").alias("value"), F.col(f"_{a}_said").alias("stated")) for a in ("ra", "dec")))
        guesses = infer_units(df.select(name.alias("catalogue"), F.inline(both)))
        for a in ("ra", "dec"):
            g = guesses.where(F.col("axis") == a).select(F.col("catalogue").alias("_g_cat"), F.col("bin").alias("_g_bin"), F.col("inferred").alias(f"_{a}_inferred"), F.col("posterior").alias(f"_{a}_post"))
            df = df.join(g, missing[a] & (name == F.col("_g_cat")) & (_bin(F.col(f"_{a}_text_value")) == F.col("_g_bin")), "left").drop("_g_cat", "_g_bin")
    for a in ("ra", "dec"):
        unit = F.coalesce(F.col(f"_{a}_said"), F.col(f"_{a}_inferred"))
        seen = F.col(f"_{a}_text_value").isNotNull()
        posterior = F.when(F.col(f"_{a}_said").isNotNull(), 1.0).otherwise(F.col(f"_{a}_post"))
        df = df.withColumns({
            f"{a}_deg": F.when(F.col(f"_{a}_text_value") == 0, 0.0).otherwise(to_degrees(F.col(f"_{a}_text_value"), unit)),
            f"{a}_used": F.when(seen, unit),
            f"{a}_unit_from": F.when(seen, F.coalesce(F.col(f"_{a}_from"), F.when(F.col(f"_{a}_inferred").isNotNull(), F.lit("inferred")))),
            f"{a}_posterior": F.when(seen, posterior),
            f"{a}_uncertain": F.when(seen, F.coalesce(posterior, F.lit(0.0)) < SURE),
        })
    return df.select(*calib.columns, *(f"{a}_{x}" for a in ("ra", "dec") for x in ("deg", "used", "unit_from", "posterior", "uncertain")))


def positions_found(calib: DataFrame, catalogues: DataFrame | None = None) -> DataFrame:
    """cal_id, ra_arcsec, dec_arcsec of every star with two readable, possible coordinates. One row for each cal_id; of
    repeated rows that disagree, the smallest position counts."""
    d = harmonise_angles(calib.select("cal_id", "catalog_code", "ra_text", "dec_text", "ra_unit", "dec_unit", "remark"), catalogues)
    possible = F.col("cal_id").isNotNull() & (F.col("ra_deg") >= 0) & (F.col("ra_deg") < 360) & (F.abs("dec_deg") <= 90)
    spot = F.struct(F.round(F.col("ra_deg") * 3600).cast("long").alias("ra_arcsec"), F.round(F.col("dec_deg") * 3600).cast("long").alias("dec_arcsec"))
    return d.where(possible).groupBy("cal_id").agg(F.min(spot).alias("p")).select("cal_id", "p.ra_arcsec", "p.dec_arcsec")


def units_inferred(calib: DataFrame, catalogues: DataFrame | None = None) -> DataFrame:
    """The mixture on its own: every row beside a copy that is robbed of all that states its unit outside the text, under a
    catalogue of its own. For the copies whose texts have no marks: cal_id, axis, unit (inferred), posterior, uncertain, stated."""
    rows = calib.select("cal_id", "catalog_code", "ra_text", "dec_text", "ra_unit", "dec_unit", "remark").distinct()
    nothing = F.lit(None).cast("string")
    robbed = rows.withColumns({"catalog_code": F.concat(F.coalesce("catalog_code", F.lit("")), F.lit(" (robbed)")), "ra_unit": nothing, "dec_unit": nothing, "remark": nothing})
    d = harmonise_angles(rows.withColumn("copy", F.lit(False)).union(robbed.withColumn("copy", F.lit(True))), catalogues)
    known = d.where("NOT copy").groupBy("cal_id").agg(*(F.min(f"{a}_used").alias(f"{a}_stated") for a in ("ra", "dec")))
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_unit_from").alias("unit_from"), F.col(f"{a}_used").alias("unit"), F.col(f"{a}_posterior").alias("posterior"), F.col(f"{a}_uncertain").alias("uncertain"), F.col(f"{a}_stated").alias("stated")) for a in ("ra", "dec")))
    return d.where("copy").join(known, "cal_id").select("cal_id", F.inline(axes)).where("unit_from = 'inferred'").drop("unit_from").distinct()
