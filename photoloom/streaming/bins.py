"""Light-curve bins of a stream. The batch and the stream run the same aggregate; the stream adds a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame) -> DataFrame:
    """event_type, hour (whole hours since 1970), n, mean."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).cast("long").alias("hour")
    return events.where("value IS NOT NULL").groupBy("event_type", hour).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def hourly_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """As ``hourly`` over a stream: event_type, window, n, mean. Readings later than ``late`` are left out, their state is freed."""
    timed = events.where("value IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def start(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write closed hours to parquet as the watermark passes them; runs until the input available now is used up."""
    return hourly_stream(events, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
