"""URL filters by a sorted digest array (operator 8).

A rule list of host and path prefixes becomes two aligned arrays in one file: 64-bit xxhash keys in
ascending order and the full rule strings they stand for. Executors memory-map the file, hash every
(host suffix, path prefix) of a batch of urls, probe all of them with one vectorised binary search
per shape and confirm each hit against the stored string, so collisions can't decide. The longest
confirmed rule wins. Urls that no rule fits are not listed, and the verdict is the default (allow).

The file is named by its content and shipped once per executor by Spark, however often a rule list is used; it grows
with the rule list, not with the urls, and its size is checked against MAX_INDEX_BYTES. The rule list may be a table.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default verdict;
repeated rows get equal results; other columns are left alone.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import LOWER, UPPER, pieces, table

#: (host, path, verdict), fixed by the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MAX_INDEX_BYTES = 1 << 30


def build_index(rules, path: str) -> None:
    """Writes count, blob size, sorted keys, string offsets, the path lengths in use, and the strings."""
    entries = {}
    for host, prefix, verdict in rules:
        entries[f"{host}{prefix}".encode()] = (host, prefix, verdict)
    order = sorted((xxhash.xxh64_intdigest(full), full) for full in entries)
    lengths = sorted({len(p.encode()) for _, p, _ in entries.values()})
    body = [(b"+" if entries[full][2] == "allow" else b"-") + full for _, full in order]
    ends = np.cumsum([0] + [len(x) for x in body]).astype(np.uint64)
    with open(path, "wb") as f:
        f.write(struct.pack("<QQ", len(order), len(lengths)))
        f.write(np.array([k for k, _ in order], np.uint64).tobytes())
        f.write(ends.tobytes())
        f.write(np.array(lengths, np.uint64).tobytes())
        f.write(b"".join(body))
    if (size := os.path.getsize(path)) > MAX_INDEX_BYTES:
        raise ValueError(f"the index has {size} bytes; the bound is {MAX_INDEX_BYTES}")


class DigestArray:
    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        n, m = struct.unpack("<QQ", self.raw[:16].tobytes())
        at = 16
        self.keys = self.raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = self.raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.lengths = [int(x) for x in self.raw[at : at + 8 * m].view(np.uint64)]
        self.blob = self.raw[at + 8 * m :]

    def find(self, strings: list[bytes]) -> list[bytes | None]:
        """The verdict sign and rule for each string that is listed, else None."""
        if not strings or not len(self.keys):
            return [None] * len(strings)
        probes = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, probes)
        out: list[bytes | None] = [None] * len(strings)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probes))
        for i in hit:
            p = int(at[i])
            while p < len(self.keys) and self.keys[p] == probes[i]:  # equal digests of different strings stand together
                full = self.blob[int(self.ends[p]) : int(self.ends[p + 1])].tobytes()
                if full[1:] == strings[i]:
                    out[i] = full
                    break
                p += 1
        return out

    def longest(self, urls: list[tuple[bytes, bytes]]) -> list[bytes | None]:
        """The longest rule for each (host, path)."""
        where, strings = [], []
        for i, (host, path) in enumerate(urls):
            if not host:
                continue
            suffixes, dot = [host], host.find(b".")
            while dot >= 0:
                suffixes.append(host[dot + 1 :])
                dot = host.find(b".", dot + 1)
            prefixes = [path[:n] for n in self.lengths if n <= len(path)]
            for s in suffixes:
                for p in prefixes:
                    where.append(i)
                    strings.append(s + p)
        best: list[bytes | None] = [None] * len(urls)
        for i, found in zip(where, self.find(strings), strict=True):
            if found is not None and (best[i] is None or len(found) > len(best[i])):
                best[i] = found
        return best


@cache
def _served() -> str:
    """The driver's folder from which its file server hands files to executors, kept as long as the process."""
    folder = tempfile.mkdtemp(prefix="keyloom-rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@lru_cache(4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def ship_rules(spark: SparkSession, rules) -> str:
    """The name under which executors find the index of rules (host, path, verdict), a list or a table."""
    if isinstance(rules, DataFrame):
        most = MAX_INDEX_BYTES // 32  # a rule takes more than that
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").limit(most + 1).collect()]
        if len(rules) > most:
            raise ValueError(f"more than {most} rules")
    rules = sorted(set(rules))
    name = f"rules-{xxhash.xxh3_128_hexdigest(repr(rules).encode())}.idx"
    path = os.path.realpath(f"{_served()}/{name}")
    if not os.path.exists(path):
        build_index(rules, f"{path}.part")
        os.replace(f"{path}.part", path)
    if path not in _shipped(spark.sparkContext.applicationId):
        spark.sparkContext.addFile(path)
        _shipped(spark.sparkContext.applicationId).add(path)
    return name


@cache
def _shipped(application: str) -> set[str]:
    return set()


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """pages' columns with host, path, rule and verdict (earlier columns of these names are replaced)."""
    name = ship_rules(pages.sparkSession, rules)
    url = F.coalesce(F.col("url"), F.lit(""))
    after = F.when(F.contains(url, F.lit("://")), F.expr("substring(coalesce(url, ''), locate('://', coalesce(url, '')) + 3)")).otherwise("")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    df = pages.withColumn("__after", after).select(*own, F.translate(F.regexp_extract("__after", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("__after", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    schema = df.schema

    def run(batches):
        for b in pieces(batches):
            n = len(b.schema.names)
            hosts, paths = b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist()
            best = _opened(name).longest([(h.encode(), p.encode()) for h, p in zip(hosts, paths, strict=True)])
            rule = pa.array([None if x is None else x[1:].decode() for x in best], pa.string())
            verdict = pa.array([default if x is None else "allow" if x[:1] == b"+" else "block" for x in best], pa.string())
            yield pa.record_batch([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    added = [T.StructField(n, T.StringType()) for n in ("rule", "verdict")]
    return df.mapInArrow(run, T.StructType([*schema.fields, *added]))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, arg_max(r.h || r.f, length(r.h || r.f)) AS rule, arg_max(r.v, length(r.h || r.f)) AS v
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.f) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
