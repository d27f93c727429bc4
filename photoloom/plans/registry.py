"""Queries of the engine's operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a data directory as attributes: ``t.frames`` (all columns; the scan reads those that a query uses)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small fixed table."""
        return self.spark.createDataFrame(rows, schema)


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Query] = {}
        self.ORACLES: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.ORACLES[name] = sql
            return f

        return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, minus zero as zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same small fixed table in SQL."""
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, row)) + ')' for row in rows)}) AS v({columns})"


def sql_clip(source: str, keys: str, k: float, iterations: int = 5, centre: str = "median", spread: str = "std") -> str:
    """CTEs c0..cn over ``source`` (keys, v): cn has what sigma clipping leaves."""
    mid = "quantile_cont(v, 0.5)" if centre == "median" else "avg(v)"
    parts = [f"c0 AS (SELECT {keys}, v FROM ({source}) s WHERE v IS NOT NULL)"]
    for i in range(iterations):
        scatter = "stddev_pop(v)" if spread == "std" else "1.482602218505602 * mad(v)"
        parts.append(f"b{i} AS (SELECT {keys}, {mid} AS m, {scatter} AS s FROM c{i} GROUP BY ALL)")
        parts.append(f"c{i + 1} AS (SELECT {', '.join(f'c{i}.{x.strip()}' for x in keys.split(','))}, v FROM c{i} JOIN b{i} ON {' AND '.join(f'c{i}.{x.strip()} IS NOT DISTINCT FROM b{i}.{x.strip()}' for x in keys.split(','))} WHERE v BETWEEN m - {k} * s AND m + {k} * s)")
    return ", ".join(parts)
