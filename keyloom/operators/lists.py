"""List commands in closed form: RPUSH with LPOP (queue), RPUSH with RPOP (stack), LPUSH, LRANGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.parse import clamp_columns


def _levels(log: DataFrame) -> DataFrame:
    """Running length, and whether a pop found an item. s is pushes less attempts; its running minimum below zero is the failed ones."""
    w = Window.partitionBy("key").orderBy("seq")
    s = F.sum(F.when(F.col("op") == "PUSH", 1).otherwise(-1)).over(w)
    out = log.withColumn("s", s)
    out = out.withColumn("m", F.least(F.lit(0), F.min("s").over(w)))
    out = out.withColumn("m0", F.coalesce(F.lag("m").over(w), F.lit(0)))
    return out.withColumns({"len": (F.col("s") - F.col("m")).cast("bigint"), "ok": (F.col("op") == "POP") & (F.col("m") == F.col("m0"))})


def queue_replies(log: DataFrame) -> DataFrame:
    """key, seq, op (PUSH or POP), item -> len after each row, and the item each POP took from the other end."""
    w = Window.partitionBy("key").orderBy("seq")
    x = _levels(log)
    x = x.withColumn("n", F.when(F.col("op") == "PUSH", F.sum(F.when(F.col("op") == "PUSH", 1)).over(w)).when(F.col("ok"), F.sum(F.when(F.col("ok"), 1)).over(w)))
    pushed = x.filter("op = 'PUSH'").select(F.col("key").alias("of"), F.col("n").alias("nth"), F.col("item").alias("popped"))
    return x.join(pushed, (F.col("key") == F.col("of")) & (F.col("n") == F.col("nth")) & F.col("ok"), "left").select("key", "seq", "op", "len", "popped")


def stack_replies(log: DataFrame) -> DataFrame:
    """The same, taking from the end pushed to: a pop's item is the previous row at its level."""
    x = _levels(log).withColumn("level", F.when(F.col("op") == "PUSH", F.col("len")).when(F.col("ok"), F.col("len") + 1))
    at = Window.partitionBy("key", "level").orderBy("seq")
    return x.withColumn("popped", F.when(F.col("ok"), F.lag("item").over(at))).select("key", "seq", "op", "len", "popped")


def lpushed(values: DataFrame) -> DataFrame:
    """key, seq, value pushed to the front one by one -> pos; the last pushed is first."""
    return values.withColumn("pos", (F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))) - 1).cast("bigint"))


def rpushed(values: DataFrame) -> DataFrame:
    return values.withColumn("pos", (F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1).cast("bigint"))


def lrange(items: DataFrame, start: Column, stop: Column) -> DataFrame:
    """items (key, pos, value) -> idx, value of the inclusive range; bounds may be negative or outside."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    lo, hi = clamp_columns(start, stop, F.col("n"))
    return items.withColumn("n", n).filter(F.col("pos").between(lo, hi)).select("key", (F.col("pos") - lo).cast("bigint").alias("idx"), "value")


def lrange_array(items: Column, start: Column, stop: Column) -> Column:
    """The same on a nested list; slice() itself neither clamps nor counts from 0."""
    lo, hi = clamp_columns(start, stop, F.size(items))
    return F.when(lo > hi, F.slice(items, 1, 0)).otherwise(F.slice(items, F.least(lo, F.size(items)) + 1, F.greatest(hi - lo + 1, F.lit(0))))
