"""Queries of the llm problems over a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.llm.encoding import encode, token_counts
from photoloom.llm.mapping import mapped_found
from photoloom.llm.matching import match_stars, matches_found
from photoloom.llm.packing import pack
from photoloom.llm.quality import structure_found, text_quality, text_statistics
from photoloom.llm.textstats import CommonWords
from photoloom.session import cut
from photoloom.sources.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_found(table(spark, sf_dir, "frames"), table(spark, sf_dir, "ref_values"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches_found(*(table(spark, sf_dir, t) for t in ("photometry", "wcs", "comp_stars")))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its odds before and its marginal probability after the messages."""
    return match_stars(*(table(spark, sf_dir, t) for t in ("photometry", "wcs", "comp_stars")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(token_counts(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "pack_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can count, too."""
    stats = text_statistics(table(spark, sf_dir, "documents"), CommonWords([]))
    return stats.select("doc_id", "word_count", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_ratio", 6).alias("symbol_ratio"), F.round("digit_ratio", 6).alias("digit_ratio"), "line_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_ids": p6_ids, "p7_packing": p7_packing, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_counts": p8_counts,
}
_BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"

ORACLES: dict[str, str] = {
    "p8_counts": rf"""
        WITH d AS (SELECT doc_id, replace(text, chr(173), '') AS t FROM documents),
        s AS (SELECT doc_id, t, length(regexp_replace(t, '[{_BLANK}]+', '', 'g')) AS solid, len(list_filter(string_split_regex(t, '[{_BLANK}]+'), lambda x: x <> '')) AS words,
              len(list_filter(string_split_regex(t, '[\n\r\x0b\x0c\x85\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_BLANK}]')))::DOUBLE AS line_count FROM d WHERE regexp_matches(t, '[^{_BLANK}\p{{C}}]'))
        SELECT doc_id, words::DOUBLE AS word_count, round(solid / words, 6) AS mean_word_length, round(length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}{_BLANK}]+', '', 'g')) / solid, 6) AS symbol_ratio,
            round(length(regexp_replace(t, '\P{{N}}+', '', 'g')) / solid, 6) AS digit_ratio, line_count
        FROM d LEFT JOIN s USING (doc_id, t)""",
}
