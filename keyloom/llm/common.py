"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.shared import cut, shared_folder  # noqa: F401  (used by the operators)

#: ASCII whitespace: the separators of words in every contract of this subpackage.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id in internal keys; it sorts below every real id.
NO_ID = -(2**63)
#: Rows and bytes of texts that a Python operator unpacks at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Words of 64 bits in a filter of keys (at most so many rows are broadcast).
FILTER_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the whitespace-separated words; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, but for single rows, about BATCH_BYTES bytes.

    Spark bounds the bytes of a batch (64 MB unless set otherwise) and a slice is no copy, so this bounds what is unpacked into Python
    objects without a change of the caller's session.
    """
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(BATCH_ROWS, b.num_rows - at)
            while n > 1 and (size := b.slice(at, n).nbytes) > BATCH_BYTES:
                n = max(1, min(n - 1, n * BATCH_BYTES // size))
            yield b.slice(at, n)
            at += n


def part_by_keys(df: DataFrame, hash_of_row: Column, keys: DataFrame, hash_of_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key surely isn't), told apart without a shuffle of df.

    A bit per hash: the table of bits has at most FILTER_WORDS rows whatever the number of keys, so it is broadcast. More keys than
    bits make more rows doubtful, which is no error: the doubtful ones are to be joined. Equal keys need equal hashes.
    """
    h = lambda c: F.pmod(c, F.lit(FILTER_WORDS * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__filter_b"))
    bits = keys.select(h(hash_of_key).alias("__filter_k")).select(F.shiftright("__filter_k", 6).alias("__filter_w"), F.col("__filter_k").bitwiseAND(F.lit(63)).cast("int").alias("__filter_b"))
    bits = bits.groupBy("__filter_w").agg(F.bit_or(bit).alias("__filter_x"))
    own = df.columns
    seen = df.withColumn("__filter_k", h(hash_of_row)).withColumn("__filter_w", F.shiftright("__filter_k", 6)).join(F.broadcast(bits), "__filter_w", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("__filter_x"), F.col("__filter_k").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return seen.filter(hit).select(*own), seen.filter(~hit).select(*own)


def give_back(spark: SparkSession) -> None:
    """Every executor collects its garbage and so returns free heap to the machine; live data stay. A heap otherwise only grows from stage to stage."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession, value: bytes, most: int):
    """Broadcast bytes whose size is checked against a documented bound."""
    if len(value) > most:
        raise ValueError(f"{len(value)} bytes to broadcast; the bound is {most}")
    return spark.sparkContext.broadcast(value)
