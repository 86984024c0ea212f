"""Line dedup by range-partitioned hashes with a secondary sort (operator 4).

Lines become (128-bit hash, document, position). They are range-partitioned by (hash, document), so the
run of a very frequent line is spread over as many partitions as its rows need, then sorted by hash,
descending document and position; a streaming pass keeps the first document of each run (the largest id) and
marks the rest. Runs that touch an edge of their partition are completed from one small summary
per partition. What is returned is a zlib-compressed keep bitmap per document; to apply them, only texts
that may lose a line are shuffled.

Defined results: null or empty text is one empty line, kept; a null doc_id counts as one document
below all ids; rows that repeat a doc_id are one document when counting, and each gets its own bitmap;
equal hashes of 128 bits are taken as equal keys; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import NO_ID, WS_CHARS, cut, part_by_keys, pieces, table

MIN_CHARS = 20
MIN_DOCS = 3
_WS = WS_CHARS.encode()
#: Lines buffered per Arrow batch of output.
_OUT = 200_000


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc, row, pos) of every line whose key has min_chars code points; row tells apart texts of a repeated id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "doc", "row", "pos"]
        for batch in pieces(batches):
            keys, doc, row, pos = bytearray(), [], [], []
            for d, r, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, line in enumerate((text or b"").split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(_WS).lower()
                    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
                        continue
                    keys += xxhash.xxh3_128_digest(key)
                    doc.append(d)
                    row.append(r)
                    pos.append(i)
                    if len(doc) >= _OUT:
                        k = np.frombuffer(bytes(keys), np.int64).reshape(-1, 2)
                        yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32())], names)
                        keys, doc, row, pos = bytearray(), [], [], []
            if doc:
                k = np.frombuffer(bytes(keys), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32())], names)

    return docs.select(*_row_key(), F.col("text").cast("binary").alias("text")).mapInArrow(run, "k1 long, k2 long, doc long, row long, pos int")


def _row_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row")


def _mark(min_docs: int):
    """Streams the sorted rows of one partition: closed runs give drops, runs at an edge are passed on whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "doc", "row", "pos", "edge"]

        def emit(part: np.ndarray, edge: bool):
            return pa.record_batch([pa.array(part[:, j]) for j in range(4)] + [pa.array(part[:, 4].astype(np.int32)), pa.array(np.full(len(part), edge))], names)

        def closed(part: np.ndarray):
            """part holds whole runs only."""
            new = np.r_[True, (part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1])]
            starts, run_of = np.flatnonzero(new), np.cumsum(new) - 1
            new_doc = new | np.r_[True, part[1:, 2] != part[:-1, 2]]
            n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            drop = (n_docs[run_of] >= min_docs) & (part[:, 2] != part[starts, 2][run_of])
            return part[drop]

        tail, first = None, None  # tail: the unfinished last run's pieces; first: key of the partition's first run
        for batch in batches:
            part = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(5)])
            if not len(part):
                continue
            if first is None:
                first = tuple(part[0, :2])
            if tail is not None:
                same = (part[:, 0] == tail[-1][0, 0]) & (part[:, 1] == tail[-1][0, 1])
                n = len(part) if same.all() else int(np.argmin(same))
                key = tuple(tail[-1][0, :2])
                if key == first:  # an edge run streams through; nothing of it is held
                    if n:
                        yield emit(part[:n], True)
                    part = part[n:]
                    if not len(part):
                        continue
                    tail = None
                else:
                    tail.append(part[:n])
                    part = part[n:]
                    if not len(part):
                        continue
                    out = closed(np.concatenate(tail))
                    if len(out):
                        yield emit(out, False)
                    tail = None
            change = np.flatnonzero((part[1:, 0] != part[:-1, 0]) | (part[1:, 1] != part[:-1, 1])) + 1
            last = int(change[-1]) if len(change) else 0
            whole = part[:last]
            if len(whole):
                lead = (whole[:, 0] == first[0]) & (whole[:, 1] == first[1])
                if lead.any():
                    yield emit(whole[lead], True)
                    whole = whole[~lead]
                if len(whole) and len(out := closed(whole)):
                    yield emit(out, False)
            rest = part[last:]
            if tuple(rest[0, :2]) == first:
                yield emit(rest, True)
                tail = [rest[:1]]
            else:
                tail = [rest]
        if tail is not None and tuple(tail[-1][0, :2]) != first:
            yield emit(np.concatenate(tail), True)

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, n_drop, bitmap) of the documents that lose lines; bit i of the unzipped bitmap is 1 if line i stays.

    Bits after the last dropped line are left out; they count as 1.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = line_keys(docs, min_chars).repartitionByRange(parts, "k1", "k2", "doc").sortWithinPartitions("k1", "k2", F.col("doc").desc(), "row", "pos")
    # written once: both uses below must see the same range bounds, also after an executor is lost
    marked = cut(sorted_keys.mapInArrow(_mark(min_docs), "k1 long, k2 long, doc long, row long, pos int, edge boolean"))
    edge = marked.filter("edge")
    # one key per partition edge: the summary's rows are bounded by twice the number of partitions
    ends = edge.groupBy("k1", "k2", "doc").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.sum("one").alias("n_docs"), F.max("doc").alias("last"))
    ends = ends.filter(F.col("n_docs") >= min_docs).select("k1", "k2", "last")
    late = edge.join(F.broadcast(ends), ["k1", "k2"]).filter(F.col("doc") != F.col("last")).select("doc", "row", "pos")
    drops = marked.filter("not edge").select("doc", "row", "pos").unionByName(late)

    def bits(pos: np.ndarray) -> bytes:
        keep = np.ones((int(pos.max()) + 8) // 8 * 8, bool)  # whole bytes, else the padding would read as dropped
        keep[pos] = False
        return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(2)
            flat, ends = pos.flatten().to_numpy(), np.r_[0, np.cumsum(pos.value_lengths().to_numpy())]
            maps = [bits(flat[i:j]) for i, j in pairwise(ends.tolist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(maps, pa.binary())], ["doc", "row", "n_drop", "bitmap"])

    return drops.groupBy("doc", "row").agg(F.collect_set("pos").alias("pos")).mapInArrow(pack, "doc long, row long, n_drop long, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return b"\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])


def with_bitmaps(docs: DataFrame) -> DataFrame:
    """docs with __n (dropped lines) and __b (bitmap), null where all lines stay; documents that surely lose none aren't shuffled."""
    doc, row = (c.alias(f"__{n}") for c, n in zip(_row_key(), ("doc", "row"), strict=True))
    maps = cut(keep_bitmaps(docs)).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("n_drop").alias("__n"), F.col("bitmap").alias("__b"))
    key = F.xxhash64("__doc", "__row")
    some, rest = part_by_keys(docs.select("*", doc, row), key, maps, key)
    whole = rest.withColumns({"__n": F.lit(None).cast("long"), "__b": F.lit(None).cast("binary")})
    return some.join(maps, ["__doc", "__row"], "left").unionByName(whole).drop("__doc", "__row")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of text; n_chars follows. A null text stays null."""

    def run(batches):
        for b in pieces(batches):
            texts = [x if m is None or x is None else kept_lines(x.encode(), m).decode() for x, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(texts, pa.string()), *b.columns[2:]], ["text", *b.schema.names[2:]])

    names = docs.columns
    rest = [c for c in names if c != "text"]
    df = with_bitmaps(docs).select("text", "__b", *rest)
    out = df.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), *(docs.schema[c] for c in rest)]))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches):
        for b in pieces(batches):
            ids, n_lines, n_drop, sha = b.column(0), [], [], []
            for text, n, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                n_drop.append(n or 0)
                sha.append(hashlib.sha256(kept_lines(text, m)).hexdigest())
            yield pa.record_batch([ids, pa.array(n_lines, pa.int64()), pa.array(n_drop, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "__n", "__b").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (f.last IS NOT NULL AND f.last <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.last IS NULL OR f.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""
