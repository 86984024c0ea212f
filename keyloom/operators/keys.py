"""Commands on keys of any type: DEL, EXISTS, TYPE, TTL, EXPIRE, INFO over a snapshot of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.parse import alive, ttl_column

TYPES = ("string", "hash", "list", "set", "zset")


def look_up(requests: DataFrame, keys: DataFrame, now_us: Column) -> DataFrame:
    """requests (req, i, key) with type and expires_at_us of live keys, else nulls."""
    live = keys.filter(alive(F.col("expires_at_us"), now_us)).select("key", "type", "expires_at_us")
    return requests.join(live, "key", "left")


def exists_counts(requests: DataFrame, keys: DataFrame, now_us: Column) -> DataFrame:
    """EXISTS counts a repeated key each time, DEL once: both per request, by one join and one aggregate."""
    return look_up(requests, keys, now_us).groupBy("req").agg(
        F.count("type").cast("bigint").alias("exists_reply"), F.count_distinct(F.when(F.col("type").isNotNull(), F.col("key"))).cast("bigint").alias("del_reply")
    )


def delete(keys: DataFrame, requests: DataFrame) -> DataFrame:
    return keys.join(requests.select("key"), "key", "left_anti")


def type_and_ttl(requests: DataFrame, keys: DataFrame, now_us: Column) -> DataFrame:
    out = look_up(requests, keys, now_us)
    return out.select("key", F.coalesce("type", F.lit("none")).alias("type"), ttl_column(F.col("type").isNotNull(), F.col("expires_at_us"), now_us).alias("ttl"))


def expire(keys: DataFrame, requests: DataFrame, now_us: Column) -> DataFrame:
    """keys with the deadlines of requests (key, seconds) put on live ones; replies are the rows it matched."""
    hit = alive(F.col("expires_at_us"), now_us) & F.col("seconds").isNotNull()
    return keys.join(requests.select("key", "seconds"), "key", "left").withColumns(
        {"expires_at_us": F.when(hit, now_us + F.col("seconds") * 1_000_000).otherwise(F.col("expires_at_us")), "updated_at_us": F.when(hit, now_us).otherwise(F.col("updated_at_us")), "reply": hit.cast("bigint")}
    ).drop("seconds")


def info(keys: DataFrame, now_us: Column) -> DataFrame:
    """Counts of live keys; the text reply leaves zset_keys out, as it always has."""
    live = keys.filter(alive(F.col("expires_at_us"), now_us))
    return live.agg(F.count(F.lit(1)).alias("total_keys"), *[F.count_if(F.col("type") == t).alias(f"{t}_keys") for t in TYPES])


def totals_before(points: DataFrame, edges: DataFrame, order: list[str], sums: list[str], by: list[str] = ()) -> DataFrame:
    """points with, for each of sums, its total over the edges (of the same by) that come before the point.

    Both have the columns of order and bucket, a coarse number that never falls along the order. Edges are summed by bucket, and
    only these totals, one row a bucket, are accumulated in one task; edges are sorted only in the buckets that hold a point.
    """
    at = [*by, "bucket"]
    asked = points.select(*at).distinct()
    none = [F.lit(0).cast("bigint").alias(c) for c in sums]
    total = [F.sum(c).alias(c) for c in sums]
    whole = edges.groupBy(*at).agg(*total).unionByName(asked.select(*at, *none)).groupBy(*at).agg(*total)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select(*at, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in sums]).join(asked, at, "left_semi")
    near = edges.join(asked, at, "left_semi").select(*at, *order, *sums)
    line = near.unionByName(points.select(*at, *order, *none, F.struct(*points.columns).alias("point")), allowMissingColumns=True)
    upto = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = line.withColumns({c: F.sum(c).over(upto) for c in sums}).filter("point is not null").join(base, at)
    return got.select("point.*", *[(F.col(c) + F.col(f"base_{c}")).alias(c) for c in sums])


def info_text(total: Column, strings: Column, hashes: Column, lists: Column, sets: Column, channels: Column, subscribers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"), F.lit("\r\n"))
    return F.concat(
        F.lit("# Server\r\n# Keyspace\r\n"), line("total_keys", total), line("string_keys", strings), line("hash_keys", hashes), line("list_keys", lists), line("set_keys", sets),
        F.lit("\r\n# PubSub\r\n"), line("channels", channels), line("subscribers", subscribers),
    )
