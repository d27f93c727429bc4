"""FITS frames: header and pixel readers over ``binaryFile``, and a writer. Blocks of 2880 bytes, cards of 80 characters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
#: Numpy types of BITPIX (fixed values).
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
FITS_FILES = r"(?i).*\.(fit|fits)$"


def parse_card(card: str) -> tuple[str, str | None] | None:
    """Keyword and value of a card (a string without quotes, a logical as true or false); None for one without a value."""
    key = card[:8].strip()
    if card[8:10] != "= " or not key:
        return None
    rest = card[10:].strip()
    if rest.startswith("'"):
        end = 1
        while end < len(rest):
            if rest[end] == "'":
                if rest[end + 1 : end + 2] != "'":
                    break
                end += 1
            end += 1
        return key, rest[1:end].replace("''", "'").rstrip()
    value = rest.split("/", 1)[0].strip()
    return key, {"T": "true", "F": "false", "": None}.get(value, value)


def read_header(data: bytes) -> tuple[dict[str, str | None], int]:
    """The cards of the first header, and where its data begin."""
    header: dict[str, str | None] = {}
    for at in range(0, len(data) - CARD + 1, CARD):
        card = data[at : at + CARD].decode("ascii", "replace")
        if card[:8].strip() == "END":
            return header, math.ceil((at + CARD) / BLOCK) * BLOCK
        if (parsed := parse_card(card)) and parsed[0] not in header:
            header[parsed[0]] = parsed[1]
    raise ValueError("no END card")


def read_image(data: bytes) -> tuple[dict[str, str | None], np.ndarray]:
    """Header and pixels (float64, BZERO and BSCALE applied, BLANK as NaN)."""
    header, at = read_header(data)
    shape = [int(header[f"NAXIS{k}"]) for k in range(int(header.get("NAXIS") or 0), 0, -1)]
    if not shape:
        return header, np.zeros((0, 0))
    raw = np.frombuffer(data, TYPES[int(header["BITPIX"])], int(np.prod(shape)), at).reshape(shape)
    image = raw.astype(float)
    if header.get("BLANK") is not None and raw.dtype.kind in "iu":
        image[raw == int(header["BLANK"])] = np.nan
    return header, image * float(header.get("BSCALE") or 1) + float(header.get("BZERO") or 0)


def write_image(image: np.ndarray, header: dict[str, object] | None = None) -> bytes:
    """A file of one image, as 64-bit floats."""

    def card(key: str, value: object) -> str:
        if isinstance(value, bool):
            v = "T" if value else "F"
        elif isinstance(value, (int, float, np.number)):
            v = repr(value.item() if isinstance(value, np.number) else value)
        else:
            return f"{key:<8}= {"'" + str(value).replace("'", "''").ljust(8) + "'":<70}"[:CARD]
        return f"{key:<8}= {v:>20}".ljust(CARD)[:CARD]

    own = {"SIMPLE": True, "BITPIX": -64, "NAXIS": image.ndim, **{f"NAXIS{k + 1}": n for k, n in enumerate(reversed(image.shape))}}
    cards = [card(k, v) for k, v in own.items()] + [card(k.upper()[:8], v) for k, v in (header or {}).items() if k.upper() not in own] + ["END".ljust(CARD)]
    head = "".join(cards).encode("ascii", "replace")
    body = image.astype(">f8").tobytes()
    return head.ljust(math.ceil(len(head) / BLOCK) * BLOCK) + body.ljust(math.ceil(len(body) / BLOCK) * BLOCK, b"\0")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(FITS_FILES))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """path, header (map), error: one row for each file; a file that is no FITS file has an error instead of a header."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((p, read_header(data)[0], None))
                except (ValueError, KeyError) as e:
                    out.append((p, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "header", "error"])

    return _files(spark, path).select("path", "content").mapInPandas(work, "path string, header map<string,string>, error string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, header, ny, nx, pixels (array, row by row), error: a file that cannot be read has an error and nothing else."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    header, image = read_image(data)
                    yield pd.DataFrame({"path": [p], "header": [header], "ny": [image.shape[0]], "nx": [image.shape[-1]], "pixels": [image.ravel()], "error": [None]})
                except (ValueError, KeyError, IndexError) as e:
                    yield pd.DataFrame({"path": [p], "header": [None], "ny": [None], "nx": [None], "pixels": [None], "error": [str(e) or type(e).__name__]})

    return _files(spark, path).select("path", "content").mapInPandas(work, "path string, header map<string,string>, ny int, nx int, pixels array<double>, error string")
