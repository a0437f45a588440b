"""Hourly means over a stream of events: the batch operator's streaming twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import rounded


def hourly_means(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(hour, field_key, n, v_mean) in tumbling hours; rows later than ``late`` are left out.

    ``events`` is a stream, or a table, of (ts, field_key, value_num).
    """
    stamped = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_t", late)
    hours = stamped.groupBy(F.window("_t", "1 hour").alias("_w"), "field_key")
    out = hours.agg(F.count("value_num").alias("n"), F.avg("value_num").alias("v_mean"))
    return out.select(F.col("_w.start").alias("hour"), "field_key", "n", rounded("v_mean", 6).alias("v_mean"))
