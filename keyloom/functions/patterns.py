"""Common uses of the primitives: sliding-window rate limits, heartbeat presence, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, window_us: int) -> DataFrame:
    """key, ts_us -> hits: requests in the window that ends here; one exactly window_us old is out, as trimming is inclusive."""
    w = Window.partitionBy("key").orderBy("ts_us").rangeBetween(-window_us + 1, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w))


def presence(events: DataFrame, ttl_us: int) -> DataFrame:
    """key, ts_us heartbeats -> sessions: online while each beat comes before the last one's deadline."""
    w = Window.partitionBy("key").orderBy("ts_us")
    gap = F.coalesce((F.col("ts_us") >= F.lag("ts_us").over(w) + ttl_us).cast("int"), F.lit(1))
    runs = events.withColumn("new", gap).withColumn("session", F.sum("new").over(w).cast("bigint"))
    return runs.groupBy("key", "session").agg(F.min("ts_us").alias("online_from"), (F.max("ts_us") + ttl_us).alias("online_to"), F.count(F.lit(1)).alias("beats"))
