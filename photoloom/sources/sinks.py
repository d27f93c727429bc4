"""Text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = 999.0


def magnitude_lines(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """One fixed-width line for each row (``line``), columns in the order of ``formats`` (printf); missing numbers are 999."""
    cells = [F.format_string(f, F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) if "f" in f else F.col(c)) for c, f in formats.items()]
    return df.select(F.concat_ws(" ", *cells).alias("line"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("line").write.mode("overwrite").text(path)


def region_lines(df: DataFrame, radius_arcsec: float = 3.0) -> DataFrame:
    """Circles on the sky in the format of region files, one line for each row (ra_deg, dec_deg); the head comes with ``REGION_HEAD``."""
    return df.where("ra_deg IS NOT NULL AND dec_deg IS NOT NULL").select(F.format_string('circle(%.7f,%.7f,%.3f")', F.col("ra_deg"), F.col("dec_deg"), F.lit(float(radius_arcsec))).alias("line"))


#: Head of a region file (fixed value).
REGION_HEAD = "# Region file format: DS9\nicrs"


def transform_documents(df: DataFrame) -> DataFrame:
    """image_id, name, content: the 3 x 3 matrix of each image (m00 to m22) as a YAML list of lists."""
    row = lambda i: F.concat(F.lit("- - "), F.concat_ws("\n  - ", *(F.col(f"m{i}{j}").cast("string") for j in range(3))))
    return df.select("image_id", F.format_string("%07d.yaml", "image_id").alias("name"), F.concat(F.concat_ws("\n", *(row(i) for i in range(3))), F.lit("\n")).cast("binary").alias("content"))


def fits_documents(df: DataFrame, key: str = "image_id", *, plane: str = "pixels") -> DataFrame:
    """``key``, name, content: each frame's ``plane`` (pixels, error, or mask, of which true is 1) as a FITS file of one image."""
    import numpy as np
    import pandas as pd

    from photoloom.sources.fits import write_image

    def work(batches):
        for pdf in batches:
            files = [write_image(np.asarray(p, float).reshape(int(ny), int(nx)), {"IMAGE_ID": k}) for k, ny, nx, p in zip(pdf[key], pdf["ny"], pdf["nx"], pdf[plane], strict=True)]
            yield pd.DataFrame({key: pdf[key], "name": [f"{k}_{plane}.fit" for k in pdf[key]], "content": files})

    return df.select(key, "ny", "nx", plane).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, name string, content binary")


def write_documents(df: DataFrame, folder: str) -> None:
    """Write each row's content under its name into a folder that all machines share, from the tasks; a file is complete or absent
    (it is renamed into place), so a task that runs twice does no harm."""

    def write(rows) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(part, os.path.join(folder, r["name"]))

    df.select("name", "content").foreachPartition(write)


def write_light_curves(df: DataFrame, folder: str, how: str = "csv") -> None:
    """Light curves (object_id, filter_name, jd, mag, mag_err) as text, a folder for each object and filter: csv with a head, or dat
    (parted by blanks)."""
    parts = df.withColumns({"object": F.col("object_id"), "filter": F.col("filter_name")}).select("jd", "mag", "mag_err", "object", "filter").repartition("object", "filter").sortWithinPartitions("object", "filter", "jd")
    parts.write.mode("overwrite").partitionBy("object", "filter").option("header", "true").option("sep", "," if how == "csv" else " ").csv(folder)
