"""Benchmark decontamination by a BM25 index of test items with block-max WAND (operator 6).

The test items are the indexed side: postings of normalised BM25 impacts (an item's impacts sum to 1), in order of
items, cut into blocks of item numbers with the largest impact of each term per block. Every training passage is a
query: a window of 2 x W words, half overlapping the next, W being the item's words rounded up to STEP times a
power of two. So an item's window depends on its own length alone; items of one W share an index.

WAND keeps a cursor per query term. The terms are put in order of their cursors' items; the pivot is where their summed largest
impacts first reach the smallest threshold, so no item before it can. If the sum of the block maxima at
the pivot stays below the block's smallest threshold, all cursors skip that block, else its items are
scored exactly. All items above their threshold are verified: the item's 5-word shingles must be in the passage to
80 %, and half of those of its question and half of those of its answer.

An item's threshold is 1 less the sum of its m largest impacts, m being the number of shingles that
verification lets miss. A missing word misses at least one shingle, so no passage that verification
accepts scores below it: retrieval loses nothing. Scores only grow with more words, so a document that
fails as one query needs no passages.

Indexes are broadcast together up to MAX_BYTES; a larger benchmark takes more passes, not more memory, and beyond
MAX_ITEMS it is read in parts. Documents are never shuffled.

The question is the text before an item's first line break, the answer the rest (both at least one
shingle). Words are lower-cased runs of letters, digits and non-ASCII characters. Defined results: items
of fewer than 5 words are no evidence and match nothing; null or empty
texts match nothing; rows that repeat a doc_id or item_id give one pair with the largest overlap; empty
tables give no pairs; other columns are left alone.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import pieces, ship, table

N = 5
SHARE = 80
K1, B = 1.2, 0.75
#: Items per block, per index; items that the driver reads at once; bytes that are broadcast at once.
BLOCK, SHARD, MAX_ITEMS, MAX_BYTES = 128, 4096, 1 << 18, 256 << 20
#: Words of a passage's step at least.
STEP = 64
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Item:
    """A test item of at least N words."""

    def __init__(self, item_id, text: bytes, words: list[bytes]):
        self.id, self.words = item_id, words
        self.grams = list(dict.fromkeys(zip(*(words[d:] for d in range(N)), strict=False)))
        head = len(tokens(text.split(b"\n", 1)[0])) if b"\n" in text else len(words) // 2
        total = len(self.grams)
        self.q = min(max(head, 1), total - 1) if total > 1 else total

    @property
    def step(self) -> int:
        """Words between its passages."""
        return STEP << max(0, (len(self.words) - 1) // STEP).bit_length()

    def verify(self, grams: set) -> tuple[int, int, int] | None:
        """(shared, shared of the question, shared of the answer) if the passage holds the item."""
        found = [g in grams for g in self.grams]
        total, q, a = len(found), sum(found[: self.q]), sum(found[self.q :])
        if 100 * (q + a) < SHARE * total or 2 * q < self.q or 2 * a < total - self.q:
            return None
        return q + a, q, a


class Bm25Index:
    """Items of one passage length."""

    def __init__(self, items: list[Item], df: Counter, n_items: int, mean_len: float):
        self.items, self.step = items, items[0].step
        self.vocab: dict[bytes, int] = {}
        entries = []
        self.block = BLOCK
        self.blocks = (len(items) + BLOCK - 1) // BLOCK
        self.size = self.blocks * BLOCK
        self.least = np.full(self.size, np.inf)
        for i, item in enumerate(items):
            tf = Counter(item.words)
            norm = K1 * (1 - B + B * len(item.words) / mean_len)
            w = {t: np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            total = sum(w.values())
            miss = len(item.grams) * (100 - SHARE) // 100
            self.least[i] = 1 - sum(sorted(w.values(), reverse=True)[:miss]) / total - 1e-9
            entries += [(self.vocab.setdefault(t, len(self.vocab)), i, x / total) for t, x in w.items()]
        entries.sort()
        term, post, self.impact = (np.array(x) for x in zip(*entries, strict=True))
        self.block_least = self.least.reshape(-1, BLOCK).min(axis=1)
        self.floor = self.block_least.min()
        #: Each posting as term * size + item: ascending, so that cursors are moved by one binary search.
        self.post = term * self.size + post
        self.first = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        self.block_max = np.zeros((len(self.vocab), self.blocks), np.float32)
        np.maximum.at(self.block_max, (term, post // BLOCK), self.impact.astype(np.float32) * np.float32(1 + 1e-6))
        self.most = self.block_max.max(axis=1)

    def retrieve(self, words: set[bytes]) -> list[int]:
        """All items whose score for this set of words reaches their threshold."""
        found: list[int] = []
        terms = np.array([self.vocab[w] for w in self.vocab.keys() & words], np.int64)
        most, floor, size = self.most[terms], self.floor - 1e-5, self.block
        if most.sum() < floor:
            return found
        base, end = terms * self.size, self.first[terms + 1]
        cursor = self.first[terms]
        item = self.post[cursor] - base  # the item at each term's cursor
        while len(terms):
            order = item.argsort()
            at = int(most[order].cumsum().searchsorted(floor))
            if at == len(order):
                break
            # no item before the pivot can reach the floor; all cursors up to its block are taken beyond it
            block = int(item[order[at]]) // size
            here = np.flatnonzero(item < (block + 1) * size)
            lo = self.post.searchsorted(base[here] + block * size)
            hi = self.post.searchsorted(base[here] + (block + 1) * size)
            if self.block_max[terms[here], block].sum() >= self.block_least[block] - 1e-5:
                n = hi - lo
                upto = n.cumsum()
                p = (lo - upto + n).repeat(n) + np.arange(upto[-1])
                score = np.bincount(self.post[p] % self.size - block * size, self.impact[p], size)
                found += (np.flatnonzero(score >= self.least[block * size : (block + 1) * size]) + block * size).tolist()
            cursor[here] = hi
            left = np.flatnonzero(cursor < end)
            if len(left) < len(terms):
                terms, base, end, cursor, most = terms[left], base[left], end[left], cursor[left], most[left]
            item = self.post[cursor] - base
        return found

    def matches(self, words: list[bytes], whole: set[bytes]) -> dict[int, tuple[int, int, int]]:
        found: dict[int, tuple[int, int, int]] = {}
        if not self.retrieve(whole):
            return found
        for at in range(0, max(1, len(words) - self.step), self.step):
            passage = words[at : at + 2 * self.step]
            near = self.retrieve(set(passage))
            if near:
                grams = set(zip(*(passage[d:] for d in range(N)), strict=False))
                for i in near:
                    hit = self.items[i].verify(grams)
                    if hit and hit > found.get(i, (0, 0, 0)):
                        found[i] = hit
        return found


def matches(indexes: list[Bm25Index], text: bytes) -> dict:
    """(shared, shared of the question, shared of the answer) of each item that the text holds, by its id."""
    words = tokens(text)
    whole, out = set(words), {}
    for index in indexes:
        for i, hit in index.matches(words, whole).items():
            key = index.items[i].id
            out[key] = max(hit, out.get(key, hit))
    return out


def build_indexes(benchmark: DataFrame) -> Iterator[bytes]:
    """Pickled lists of indexes, each of at most MAX_BYTES. What an item matches doesn't depend on the other items, nor on their order."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).filter("text is not null")
    parts = max(1, -(-rows.count() // MAX_ITEMS))
    for part in range(parts):
        some = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        items = []
        for i, text in some.collect():
            words = tokens(bytes(text))
            if len(words) >= N:
                items.append(Item(i, bytes(text), words))
        if not items:
            continue
        items.sort(key=lambda x: (x.step, x.id is None, x.id or 0, x.words))
        df = Counter(w for x in items for w in set(x.words))
        mean = sum(len(x.words) for x in items) / len(items)
        held: list[bytes] = []
        for _, same in groupby(items, key=lambda x: x.step):
            same = list(same)
            for i in range(0, len(same), SHARD):
                raw = pickle.dumps(Bm25Index(same[i : i + SHARD], df, len(items), mean))
                if held and sum(map(len, held)) + len(raw) > MAX_BYTES - (1 << 20):
                    yield pickle.dumps(held)
                    held = []
                held.append(raw)
        yield pickle.dumps(held)


def _loaded(raw: bytes) -> list[Bm25Index]:
    return [pickle.loads(x) for x in pickle.loads(raw)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_question, n_answer of every document that holds a test item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_question long, n_answer long")
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    names = ["doc_id", "item_id", "n_shared", "n_question", "n_answer"]
    for raw in build_indexes(benchmark):
        held = ship(spark, raw, MAX_BYTES)

        def run(batches, held=held):
            indexes = _loaded(held.value)
            for b in pieces(batches):
                rows = [(d, i, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, m in matches(indexes, t).items()]
                if rows:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        out = out.unionByName(slim.mapInArrow(run, out.schema))
    best = F.max(F.struct("n_shared", "n_question", "n_answer")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a test item; row by row, nothing is shuffled."""
    out = docs
    for raw in build_indexes(benchmark):
        held = ship(docs.sparkSession, raw, MAX_BYTES)

        def run(batches, held=held):
            indexes = _loaded(held.value)
            for b in pieces(batches):
                keep = pa.array([t is None or not matches(indexes, t) for t in b.column(b.num_columns - 1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(keep)

        out = out.select("*", F.col("text").cast("binary").alias("__bytes")).mapInArrow(run, docs.schema)
    return out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Verification alone, over all pairs that share a shingle: what retrieval must not lose.
ORACLE = r"""
WITH bw AS (SELECT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
st AS (SELECT item_id, CAST(64 * pow(2, CASE WHEN len(w) <= 64 THEN 0 ELSE CAST(floor(log2((len(w) - 1) // 64)) AS BIGINT) + 1 END) AS BIGINT) AS s FROM bw),
bg AS (SELECT item_id, g, min(j) AS j FROM (SELECT item_id, unnest(range(0, len(w) - 4)) AS j, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM bw WHERE len(w) >= 5) GROUP BY item_id, g),
bo AS (SELECT item_id, g, row_number() OVER (PARTITION BY item_id ORDER BY j) - 1 AS o, count(*) OVER (PARTITION BY item_id) AS total FROM bg),
bq AS (SELECT bo.*, CASE WHEN total > 1 THEN least(greatest(CASE WHEN contains(text, chr(10)) THEN len(regexp_extract_all(string_split(text, chr(10))[1], '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) ELSE len(w) // 2 END, 1), total - 1) ELSE total END AS q
       FROM bo JOIN bw USING (item_id)),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, s, p, w[p * s + 1 : p * s + 2 * s] AS w FROM (SELECT doc_id, w, s, unnest(range(0, greatest(1, CAST(ceil((len(w) - s) / s) AS BIGINT)))) AS p FROM dw, (SELECT DISTINCT s FROM st))),
dg AS (SELECT DISTINCT doc_id, s, p, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM (SELECT doc_id, s, p, w, unnest(range(0, len(w) - 4)) AS j FROM dp WHERE len(w) >= 5)),
m AS (SELECT doc_id, item_id, p, any_value(q) AS q, any_value(total) AS total, count(*) AS n_shared, count(*) FILTER (o < q) AS n_question, count(*) FILTER (o >= q) AS n_answer
      FROM dg JOIN bq USING (g) JOIN st USING (item_id, s) GROUP BY doc_id, item_id, p),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared DESC, n_question DESC) AS r FROM m
      WHERE 100 * n_shared >= 80 * total AND 2 * n_question >= q AND 2 * n_answer >= total - q)
SELECT doc_id, item_id, n_shared, n_question, n_answer FROM v WHERE r = 1
"""
