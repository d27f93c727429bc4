"""Parameter files, and comparison stars as a chart service lists them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names of catalogues (fixed values).
CATALOGUES = {
    "UCAC4": "I/322A",
    "GSC2.3": "I/305",
    "URAT1": "I/329",
    "NOMAD": "I/297",
    "HMUBV": "II/168/ubvmeans",
    "GSPC2.4": "II/272/gspc24",
    "APASS": "II/336/apass9",
    "Swift/UVOT": "II/339/uvotssc1",
    "XMM-OM": "II/370/xmmom5s",
    "VRI-NCC": "J/MNRAS/443/725/catalog",
    "USNO-B1.0": "I/284/out",
    "Stetson_2019": "J/MNRAS/485/3042/table4",
    "Pancino_2022": "J/A+A/664/A109/table5",
    "APOP_Qi_2015": "I/331/apop",
    "SDSS_Release_16": "V/147/sdss12",
}
#: What a catalogue's columns are called where its record does not say (fixed values).
DEFAULT_COLUMNS = {"ra": "RAJ2000", "dec": "DEJ2000", "mag_b": "Bmag", "mag_v": "Vmag", "mag_r": "rmag", "mag_i": "imag", "err_b": "e_Bmag", "err_v": "e_Vmag", "err_r": "e_rmag", "err_i": "e_imag"}
HOURS = {"hourangle", "hour", "h"}


def catalogue_id(name: str) -> str:
    """The identifier of a catalogue that is named by an alias or by its identifier."""
    return CATALOGUES.get(name, name)


def standard_columns(landed: DataFrame, names: dict[str, str] | None = None, *, ra_unit: str = "deg") -> DataFrame:
    """A landed catalogue with the engine's columns (ra_deg, dec_deg, mag_*, err_*): ``names`` says what a column is called there,
    the defaults fill the rest; magnitudes that the catalogue lacks are null, and so is the error of such a magnitude."""
    names = {**DEFAULT_COLUMNS, **(names or {})}
    have = set(landed.columns)
    col = lambda k: F.col(f"`{names[k]}`").cast("double") if names.get(k) in have else F.lit(None).cast("double")
    ra = col("ra") * 15 if ra_unit in HOURS else col("ra")
    bands = [k for k in names if k.startswith(("mag_", "err_"))]
    return landed.select(ra.alias("ra_deg"), col("dec").alias("dec_deg"), *(col(k).alias(k) for k in bands))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """path, name, value (as JSON), error: the entries of JSON and YAML files. A file that cannot be read has no entries but an error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    if p.endswith(".json"):
                        got = json.loads(bytes(data))
                    else:
                        import yaml

                        got = yaml.safe_load(bytes(data))
                    out += [(p, str(k), json.dumps(v, default=str), None) for k, v in (got or {}).items()]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file of parameters is reported
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "value", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, name string, value string, error string")


def chart_stars(answers: DataFrame, filters: list[str], *, body: str = "body") -> DataFrame:
    """auid, ra, dec, and mag_x, err_x for each of ``filters``, from the JSON answers of a chart service (column ``body``).  A band
    belongs to the filter that its name begins with; of several the last one counts; a filter without a band has 0.0, as the
    service's users expect."""
    kind = "photometry array<struct<auid:string,ra:string,dec:string,bands:array<struct<band:string,mag:double,error:double>>>>"
    stars = answers.select(F.explode(F.from_json(body, kind)["photometry"]).alias("s"))

    def of(f: str, what: str):
        own = F.filter("s.bands", lambda b: F.substring(b["band"], 1, 1) == f)
        return F.coalesce(F.try_element_at(own, F.lit(-1))[what], F.lit(0.0)).alias(f"{'mag' if what == 'mag' else 'err'}_{f.lower()}")

    return stars.select("s.auid", "s.ra", "s.dec", *(of(f, w) for f in filters for w in ("mag", "error")))
