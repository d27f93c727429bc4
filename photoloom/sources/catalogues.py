"""Catalogue and model files: VOTables and isochrone listings."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def votable(spark: SparkSession, path: str) -> DataFrame:
    """path, row_no, fields (map from a column's name to its text, empty cells null) of every row of every table."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                root = ElementTree.fromstring(bytes(data))
                out = []
                for table in root.iter():
                    if table.tag.rpartition("}")[2] != "TABLE":
                        continue
                    names = [f.get("name") or f.get("ID") for f in table.iter() if f.tag.rpartition("}")[2] == "FIELD"]
                    for row in (x for x in table.iter() if x.tag.rpartition("}")[2] == "TR"):
                        cells = [(c.text or "").strip() or None for c in row]
                        out.append((p, len(out), dict(zip(names, cells, strict=False))))
                yield pd.DataFrame(out, columns=["path", "row_no", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, row_no int, fields map<string,string>")


def good_rows(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows whose flags are all present and zero (a star that is flagged multiple or variable is no calibrator)."""
    for f in flags:
        rows = rows.where(F.try_element_at("fields", F.lit(f)).try_cast("double") == 0)
    return rows


def isochrones(spark: SparkSession, path: str) -> DataFrame:
    """path, iso_id, age, seq, cols: the points of isochrone listings.

    Each file is small and read whole. A line that does not begin with a number is a header; a number after a header begins a new
    isochrone. The age stands in the header as "Age = 2.5 Gyr" or "age 120 Myr" (Gyr from 1000 Myr on) and is in Gyr.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\R")).alias("line", "text"))
    d = files.where(F.trim("text") != "").withColumn("cols", F.split(F.trim("text"), r"\s+"))
    d = d.withColumn("point", F.col("cols")[0].try_cast("double").isNotNull())
    w = W.partitionBy("path").orderBy("line")
    age = F.regexp_extract("text", r"(?i)age\s*[=:]?\s*([0-9.eE+-]+)\s*([MG]?yr)?", 1).try_cast("double")
    unit = F.lower(F.regexp_extract("text", r"(?i)age\s*[=:]?\s*([0-9.eE+-]+)\s*([MG]?yr)?", 2))
    gyr = F.when(unit == "myr", age / 1000).when(unit == "yr", age / 1e9).otherwise(age)
    d = d.withColumns({"new": (F.col("point") & ~F.coalesce(F.lag("point").over(w), F.lit(False))).cast("int"), "head_age": F.when(~F.col("point"), gyr)})
    d = d.withColumns({"iso_id": F.sum("new").over(w), "age": F.last("head_age", ignorenulls=True).over(w)}).where("point")
    seq = F.row_number().over(W.partitionBy("path", "iso_id").orderBy("line")) - 1
    return d.select("path", F.col("iso_id").cast("int").alias("iso_id"), "age", seq.alias("seq"), F.transform("cols", lambda c: c.try_cast("double")).alias("cols"))
