"""Column helpers for hand-typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(text: Column) -> Column:
    """Any run of white space as one blank, none at the ends; typographic minus signs and primes as ASCII."""
    ascii_ = F.translate(text, "−–—′’″”ºʰᵐˢ", "---''\"\"°hms")
    return F.trim(F.regexp_replace(ascii_, r"[\s  -​ 　]+", " "))
