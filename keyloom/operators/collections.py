"""Hash, set and sorted-set commands in closed form.

All three are sets of (key, member) with a payload (a field's value, nothing, a score), so they share
their plans: the last write per member decides the snapshot, and the previous event of the same
member decides a reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.parse import clamp_columns


def snapshot(log: DataFrame, payload: str) -> DataFrame:
    """key, member, seq, op (PUT or CUT), payload -> live members with their last payload."""
    last = log.groupBy("key", "member").agg(F.max_by(F.struct("op", payload), "seq").alias("w"))
    return last.filter("w.op = 'PUT'").select("key", "member", f"w.{payload}")


def member_replies(log: DataFrame) -> DataFrame:
    """key, member, seq, op -> the log with changed: 1 where PUT added or CUT removed the member.

    HSET, SADD and ZADD count what they add, HDEL and SREM what they remove; sum by command for multi-member ones.
    """
    before = F.lag("op").over(Window.partitionBy("key", "member").orderBy("seq"))
    changed = F.when(F.col("op") == "PUT", before.isNull() | (before == "CUT")).otherwise(F.coalesce(before == "PUT", F.lit(False)))
    return log.withColumn("changed", changed.cast("bigint"))


def card(members: DataFrame) -> DataFrame:
    """SCARD, ZCARD and the length of a hash: a count, without the sort."""
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def sorted_members(members: DataFrame) -> DataFrame:
    """SMEMBERS: index in byte order."""
    return members.withColumn("idx", (F.row_number().over(Window.partitionBy("key").orderBy("member")) - 1).cast("bigint"))


def is_member(requests: DataFrame, members: DataFrame) -> DataFrame:
    """SISMEMBER for requests (key, member)."""
    return requests.join(members.select("key", "member", F.lit(1).cast("bigint").alias("hit")), ["key", "member"], "left").select("key", "member", F.coalesce("hit", F.lit(0)).cast("bigint").alias("reply"))


def remove(members: DataFrame, requests: DataFrame) -> DataFrame:
    """HDEL and SREM on a snapshot; a key without members left is gone by itself."""
    return members.join(requests, ["key", "member"], "left_anti")


def hgetall(fields: DataFrame) -> DataFrame:
    """Flat field, value, ... reply in byte order of the fields."""
    pairs = F.sort_array(F.collect_list(F.struct("member", "value")))
    return fields.groupBy("key").agg(F.flatten(F.transform(pairs, lambda p: F.array(p["member"], p["value"]))).alias("reply"))


def put(fields: DataFrame, update: DataFrame) -> DataFrame:
    """HSET on a snapshot: fields of update (key, member, value, and seq if a field is repeated) win, the last of each."""
    key, rest = ["key", "member"], [c for c in update.columns if c not in ("key", "member", "seq")]
    new = update.groupBy(*key).agg(*[F.max_by(c, "seq").alias(c) for c in rest]) if "seq" in update.columns else update
    return fields.join(new.select(*key), key, "left_anti").unionByName(new)


def zrange(members: DataFrame, start: int, stop: int) -> DataFrame:
    """idx, member, score by (score, member bytes), NaN last.

    Bounds of one sign need no count: from the front an ascending rank, from the end a descending one, both
    with a limit that the optimizer pushes below the shuffle.
    """
    up, down = Window.partitionBy("key").orderBy("score", "member"), Window.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    if start >= 0 and stop >= 0:
        ranked = members.withColumn("r", F.row_number().over(up)).filter(F.col("r") <= stop + 1)
        return ranked.withColumn("idx", (F.col("r") - 1).cast("bigint")).filter(F.col("idx") >= start).drop("r")
    if start < 0 and stop < 0:
        ranked = members.withColumn("r", F.row_number().over(down)).filter(F.col("r") <= -start)
        first = F.max("r").over(Window.partitionBy("key"))
        return ranked.filter(F.col("r") >= -stop).withColumn("idx", (first - F.col("r")).cast("bigint")).drop("r")
    ranked = members.withColumns({"r": (F.row_number().over(up) - 1).cast("bigint"), "n": n})
    lo, hi = clamp_columns(F.lit(start), F.lit(stop), F.col("n"))
    return ranked.filter(F.col("r").between(lo, hi)).withColumn("idx", F.col("r") - lo).drop("r", "n")


def in_score_range(score: Column, low: Column, high: Column) -> Column:
    """Inclusive; NaN, as score or bound, is in no range."""
    return ~F.isnan(score) & ~F.isnan(low) & ~F.isnan(high) & (score >= low) & (score <= high)


def zremrangebyscore(members: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number removed per key."""
    hit = in_score_range(F.col("score"), low, high)
    return members.filter(~hit), members.groupBy("key").agg(F.count_if(hit).alias("removed"))
