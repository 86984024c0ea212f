"""Keyspace inputs derived from the analytic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (user), seq (event), ts_us, event_type, value; event ids follow time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), us.alias("ts_us"), "event_type", "value")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed log for the whole engine: every event is a command on its user's key or its event type's set."""
    e = events(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    name = lambda kind: F.concat(F.lit(f"{kind}:"), "key")
    pick = [
        ("SET", [name("s"), s("seq"), F.lit("EX"), F.lit("86400")]), ("INCR", [name("n")]), ("GET", [name("s")]), ("EXPIRE", [name("n"), F.lit("43200")]),
        ("HSET", [name("h"), F.col("event_type"), s("seq")]), ("HDEL", [name("h"), F.col("event_type")]), ("RPUSH", [name("l"), s("seq")]), ("LPUSH", [name("l"), s("seq"), F.col("event_type")]),
        ("LPOP", [name("l")]), ("RPOP", [name("l")]), ("SADD", [F.concat(F.lit("t:"), "event_type"), F.col("key")]), ("ZADD", [F.lit("board"), s("seq"), F.col("key")]),
        ("ZREMRANGEBYSCORE", [F.lit("board"), F.lit("-inf"), (F.col("seq") - 2000).cast("string")]), ("DEL", [name("n"), name("s"), name("n")]), ("EXISTS", [name("h"), name("h"), name("l")]), ("TTL", [name("n")]),
    ]
    return _picked(e, pick, F.concat(F.lit("c"), F.pmod("seq", F.lit(7)).cast("string")))


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a command on its user's key, which changes its type: strings with and without deadline, counters, sets, and wrong options."""
    e = events(spark, sf_dir)
    key, seq = F.col("key"), F.col("seq").cast("string")
    pick = [
        ("SET", [key, seq]), ("SET", [key, seq, F.lit("px"), F.lit("7200000")]), ("INCR", [key]), ("GET", [key]), ("SADD", [key, F.col("event_type")]), ("DEL", [key]),
        ("SET", [key, seq, F.lit("EX"), F.lit("0")]), ("SET", [key, seq, F.lit("NX")]), ("TYPE", [key]), ("INCR", [key]),
    ]
    return _picked(e, pick, F.lit("c"))


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a ZADD of its user to its event type's key, with scores of all kinds of text."""
    e = events(spark, sf_dir)
    texts = [F.col("seq").cast("string"), F.lit("inf"), F.lit("-Infinity"), F.lit("NaN"), F.lit("0x1.8p4"), F.lit("1e400"), F.lit("oops")]
    return _picked(e, [("ZADD", [F.col("event_type"), t, F.col("key")]) for t in texts], F.lit("c"))


def subscriber_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a connection that subscribes (signup) to and unsubscribes (error) from a channel and sends other commands; one more publishes and asks for INFO."""
    e = events(spark, sf_dir)
    channel = F.concat(F.lit("c"), (F.col("key").cast("bigint") % 4).cast("string"))
    kind, none = F.col("event_type"), F.array().cast("array<string>")
    asks = (kind == "purchase") & (F.col("seq") % 8 == 0)
    cmd = F.when(asks, "INFO").when(kind == "signup", "SUBSCRIBE").when(kind == "error", "UNSUBSCRIBE").when(kind == "purchase", "PUBLISH").when(kind == "view", "PING").otherwise("GET")
    args = F.when(asks | (kind == "view"), none).when(kind == "purchase", F.array(channel, F.col("seq").cast("string"))).when(kind.isin("signup", "error"), F.array(channel)).otherwise(F.array(F.lit("x")))
    return e.select("seq", "ts_us", F.when(kind == "purchase", "hub").otherwise(F.concat(F.lit("u"), "key")).alias("conn_id"), cmd.alias("cmd"), args.alias("args"))


def _picked(e: DataFrame, pick: list, conn) -> DataFrame:
    k = F.pmod("seq", F.lit(len(pick)))
    cmd, args = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for i, (c, a) in enumerate(pick):
        cmd, args = F.when(k == i, F.lit(c)).otherwise(cmd), F.when(k == i, F.array(*a)).otherwise(args)
    return e.select("seq", "ts_us", conn.alias("conn_id"), cmd.alias("cmd"), args.alias("args"))
