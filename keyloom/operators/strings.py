"""String commands over a log of one kind of write per row, in closed form: SET, SETEX, DEL, GET, INCR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.parse import alive


def replay_strings(log: DataFrame) -> DataFrame:
    """key, seq, ts_us, op (SET, DEL or GET), value, ttl_us (null: none) -> the log with what each GET sees.

    SET overwrites value and deadline and DEL removes both, so the last write before a row decides: one
    window per key, no self-join.
    """
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("op") != "GET", F.struct("op", "value", (F.col("ts_us") + F.col("ttl_us")).alias("deadline")))
    last = log.withColumn("w", F.last(write, ignorenulls=True).over(w))
    seen = (F.col("w.op") == "SET") & alive(F.col("w.deadline"), F.col("ts_us"))
    return last.select("key", "seq", "ts_us", "op", F.coalesce(seen, F.lit(False)).alias("live_before"), F.when(seen, F.col("w.value")).alias("value_before"), F.when(seen, F.col("w.deadline")).alias("deadline_before"))


def snapshot_strings(log: DataFrame, now_us) -> DataFrame:
    """Live strings after the log: last write per key, by a map-side combinable aggregate."""
    last = log.filter("op <> 'GET'").groupBy("key").agg(F.max_by(F.struct("op", "value", (F.col("ts_us") + F.col("ttl_us")).alias("expires_at_us"), F.col("ts_us").alias("updated_at_us")), "seq").alias("w"))
    return last.select("key", "w.*").filter((F.col("op") == "SET") & alive(F.col("expires_at_us"), now_us)).drop("op")


def incr_replies(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """key, seq -> reply of each INCR on keys that only INCR touches; base (key, value) gives their start."""
    w = Window.partitionBy("key").orderBy("seq")
    out = log.withColumn("n", F.row_number().over(w).cast("bigint"))
    if base is None:
        return out.withColumnRenamed("n", "reply")
    return out.join(base, "key", "left").withColumn("reply", F.col("n") + F.coalesce("value", F.lit(0))).drop("n", "value")
