"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry
from photoloom.plans import problems, reference
from tests.oracle import compare, connect

NAMES = [*reference.QUERIES, *problems.QUERIES]
#: Queries that SQL does not express, and the tests that compare them with brute force or planted cases.
ELSEWHERE = {"p1_found": "test_units", "p1_inferred": "test_units", "p2_found": "test_spikes", "p2_scores": "test_spikes", "mc_samples": "test_whole", "mc_arithmetic": "test_whole"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert compare(spark, duck, sf, query, sql) == ""
    else:
        assert name in ELSEWHERE and (Path(__file__).parent / f"{ELSEWHERE[name]}.py").exists()
        assert query(spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_gives_the_rows_of_the_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from photoloom.streaming.bins import hourly, start

    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.parquet(f"{tmp_path}/in/events")
    end = events.agg(F.max("ts")).first()[0]
    late = events.limit(1).withColumn("ts", F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 9 DAYS"))
    late.write.mode("append").parquet(f"{tmp_path}/in/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/events")
    for _ in range(2):
        q = start(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        q.awaitTermination(120)
    got = {(r.event_type, int(r.window.start.timestamp()) // 3600): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.event_type, r.hour): r.n for r in hourly(events).collect()}
    assert got == want
