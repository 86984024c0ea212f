"""N-gram Jaccard self-join by PartEnum signatures (operator 9).

A document's set holds its distinct 5-word shingles (64-bit hashes). Equal sets are one node (128-bit
digest), so copies are never expanded. Sizes are cut into bands [l, 1.25 l]; a linked pair lies in one
band or two neighbouring ones, so each set joins under its own band's tag and the next one's. Per tag
the shingle domain is partitioned in two levels, n1 partitions of n2 = 3 cells, and for each partition the
subsets of n2 - k2 = 2 cells are enumerated (k2 = 1): a signature is a subset and the shingles that the set has in its
cells. A pair of sets differs in at most k shingles, k = floor((|a| + largest |b|) / 9). A partition with one differing
cell loses two of its three signatures, one with more loses all, so k differences lose at most n1 + k of
them (2 k if k < n1). n1 is chosen by band so that more than that are left: k + 1 up to bands of SMALL, where cells
are often empty, and 0.6 (k + 1) above. Empty subsets, which all sets would share, are left out; a set left with too few
signatures emits one common signature as well. As no more than D = n1 + k can be lost, the first
D + 1 signatures of both sets, in one global order, still share one, and only these are emitted. The order
puts subsets made up of frequent shingles last; which shingles count as frequent is a bounded table
from a sample, and can't change the result, only its cost.

Signatures travel as packed blobs per shuffle partition, 32 bits and an index each. Groups of equal
signatures are filed under a centre, the member with the most frequent shingles (then, the most connected one),
which is mostly the same for all groups of a family. A centre's family, all that
share a group with it, is verified at once by matrix products on the full sets, after small profiles have
proved some members unlinked. A family above FAMILY nodes is verified against its centre in chunks; only
members that this leaves outside the centre's component are then compared with the others, profiles
first, block by block, less what the triangle inequality of the Jaccard distance rules out. Links that are implied by a component aren't listed. Components come from
min-label propagation with pointer jumping, checkpointed.

Defined results: null or blank text has an empty set and is linked with nothing; texts under 5 words
are one shingle of all words; rows that repeat a doc_id are one document; a row with null doc_id
takes part under a hash of its text and its component is the smallest real id, else null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, part_by_keys, pieces, ship, table

N = 5
#: Similarity as a percentage: linked when 100 * intersection >= SHARE * union.
SHARE = 80
#: Cells of a partition; bands up to which there are as many partitions as a pair may differ in shingles, and one more.
CELLS, SMALL = 3, 64
#: Sample for the table of frequent shingles: one document of SAMPLE_OF, at least MIN_SEEN of them; size bound.
SAMPLE_OF, MIN_SEEN, MAX_FREQUENT = 16, 4, 1 << 17
#: Shuffle partitions that are one partition of signatures: fewer tasks name the same family. Shingles of such a partition at most, on average:
#: what a task holds at once is bounded, whatever the number of documents.
PER_TASK, PART_SHINGLES = 3, 20_000_000
#: Sets that are compared all with all at once.
FAMILY = 384
#: Counts in a profile; profiles that are compared all with all at once.
BUCKETS, PROFILES = 512, 2048
#: Slots of the table of frequent shingles, bits of the filter for documents to verify: both of fixed size.
SLOTS, FILTER = 22, 24
_U = np.uint64
_MULT = [_U(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(N)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, _U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(w) - N + 1)
    h = np.full(n, min(N, len(w)), _U)
    for j in range(min(N, len(w))):
        h += w[j : j + n] * _MULT[j]
    h = np.sort(mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def digest(s: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set, as two signed longs."""
    a = int(mix(s).sum(dtype=_U)) ^ len(s)
    b = int(np.bitwise_xor.reduce(mix(s ^ _U(0x5851F42D4C957F2D)))) if len(s) else 0
    return tuple(int(np.array(x, _U).astype(np.int64)) for x in (a, b))


def bands(most: int) -> list[tuple[int, int]]:
    out, l = [], 1
    while l <= most:
        out.append((l, 100 * l // SHARE))
        l = out[-1][1] + 1
    return out


_BANDS = bands(1 << 40)
_ENDS = np.array([r for _, r in _BANDS])


def slot_table(hashes: np.ndarray) -> np.ndarray:
    """True in the slots that hold a frequent shingle. A rare one in such a slot counts as frequent too, for all documents alike."""
    out = np.zeros(1 << SLOTS, bool)
    out[hashes >> _U(64 - SLOTS)] = True
    return out


def partitions(k: int, most: int) -> int:
    """n1 for sets that differ in at most k shingles, in a band of sizes up to most."""
    return k + 1 if most <= SMALL else 3 * (k + 1) // 5 + 1


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """64-bit signatures of a set of shingle hashes; frequent: slot_table() of the common ones."""
    size, out = len(s), []
    own = int(np.searchsorted(_ENDS, size))
    common = frequent[s >> _U(64 - SLOTS)]
    for tag in (own, own + 1):
        r = _BANDS[tag][1]
        # linked sets a, b have a symmetric difference of at most (|a| + |b|) / 9
        k = (size + min(r, 100 * size // SHARE)) * (100 - SHARE) // (100 + SHARE)
        if k == 0 or (tag > own and 100 * size // SHARE < _BANDS[tag][0]):
            continue  # only equal sets, or none
        n1 = partitions(2 * r * (100 - SHARE) // (100 + SHARE), r)
        cell = (((s >> _U(32)) * _U(CELLS * n1)) >> _U(32)).astype(np.int64)  # s is sorted, so cells are runs
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        held = np.zeros(CELLS * n1, _U)
        held[cell[start]] = np.add.reduceat(mix(s + _U(tag)), start)
        full, late = np.zeros(CELLS * n1, bool), np.ones(CELLS * n1, bool)
        full[cell[start]] = True
        late[cell[start]] = np.logical_and.reduceat(common, start)
        left, right = _subsets(n1)
        token = mix(held[left] * _MULT[0] + held[right] * _MULT[1] + np.arange(len(left), dtype=_U) * _MULT[2] + _U(tag * 0x9E3779B97F4A7C15 % (1 << 64)))
        some, last = full[left] | full[right], (late[left] & late[right])
        token, last = token[some], last[some]
        lost = min(2 * k, n1 + k)
        if len(token) > lost:
            token = token[np.lexsort((token, last))[: lost + 1]]
        else:
            token = np.append(token, mix(np.array([tag], _U) ^ _U(0xABCDEF)))
        out.append(token)
    return np.concatenate(out) if out else np.empty(0, _U)


@lru_cache(256)
def _subsets(n1: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each subset, partition by partition."""
    pairs = np.array(list(combinations(range(CELLS), 2)))
    both = (np.arange(n1)[:, None, None] * CELLS + pairs).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _ids(docs: DataFrame) -> DataFrame:
    """id, doc_id, text. id is the column __node, if there is one, else doc_id or, where that is null, a hash of the text."""
    node = F.col("__node") if "__node" in docs.columns else F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(node.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, a, b of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            n, a, b = [], [], []
            for t in x.column(2).to_pylist():
                s = shingles(t)
                d = digest(s)
                n.append(len(s))
                a.append(d[0])
                b.append(d[1])
            yield pa.record_batch([x.column(0), x.column(1), *(pa.array(v, pa.int64()) for v in (n, a, b))], ["id", "doc_id", "n_shingles", "a", "b"])

    return _ids(docs).mapInArrow(run, "id long, doc_id long, n_shingles long, a long, b long")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many different documents of a sample. A wrong or empty answer costs time, not links."""

    def run(batches):
        for x in pieces(batches):
            keys, ids = [], []
            for t in x.column(2).to_pylist():
                s = shingles(t)
                keys.append(s.astype(np.int64))
                ids.append(np.full(len(s), digest(s)[0]))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["s", "doc"])

    some = _ids(docs).filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_OF)) == 0)
    seen = some.mapInArrow(run, "s long, doc long").groupBy("s").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count(F.lit(1)).alias("n"))
    # copies of one set alone don't make its shingles frequent
    top = seen.filter((F.col("n") >= MIN_SEEN) & (F.col("x") != F.col("y"))).orderBy(F.desc("n"), "s").limit(MAX_FREQUENT)
    got = top.select("s").toPandas()["s"].to_numpy(np.int64)
    return slot_table(got.astype(_U))


def _packed(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """(p, blob) rows: the signatures of a batch of documents that go to partition p."""
    held = ship(docs.sparkSession, frequent.tobytes(), 1 << SLOTS)

    def run(batches):
        common = np.frombuffer(held.value, bool)
        nodes: dict[tuple[int, int], int] = {}
        sigs, weight, total = [], [], 0

        def flush():
            sig, own = np.concatenate(sigs), np.repeat(np.arange(len(sigs), dtype=np.int64), [len(x) for x in sigs])
            keys, usual = np.array(list(nodes), np.int64), np.array(weight, np.int32)
            part = ((sig >> _U(32)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, own, part = sig[order], own[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for i, j in pairwise([*cuts.tolist(), len(part)]):
                used, count = np.unique(own[i:j], return_counts=True)
                blob = np.int64(len(used)).tobytes() + keys[used].tobytes() + usual[used].tobytes() + count.astype(np.int32).tobytes() + (sig[i:j] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()
                yield int(part[i]), blob

        def rows(pairs):
            return pa.record_batch([pa.array([p for p, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["p", "blob"])

        for x in pieces(batches):
            for t in x.column(2).to_pylist():
                s = shingles(t)
                key = digest(s)
                if not len(s) or key in nodes:
                    continue
                sig = signatures(s, common)
                if not len(sig):
                    continue
                nodes[key] = len(nodes)
                sigs.append(sig)
                weight.append(int(common[s >> _U(64 - SLOTS)].sum()))
                total += len(sig)
                if total > 1_000_000:
                    yield rows(list(flush()))
                    nodes, sigs, weight, total = {}, [], [], 0
        if sigs:
            yield rows(list(flush()))

    return _ids(docs).mapInArrow(run, "p int, blob binary")


def _unpack(blob: bytes):
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    keys = np.frombuffer(blob, np.int64, 2 * n, 8).reshape(n, 2)
    usual = np.frombuffer(blob, np.int32, n, 8 + 16 * n)
    count = np.frombuffer(blob, np.int32, n, 8 + 20 * n)
    return keys, usual, count, np.frombuffer(blob, np.uint32, int(count.sum()), 8 + 24 * n)


def families(docs: DataFrame, frequent: np.ndarray, n_shingles: int) -> DataFrame:
    """(a, b, ca, cb): node (a, b) shares a signature with others whose centre is (ca, cb). The centre is in its own family.

    n_shingles: of all different sets together.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PER_TASK, -(-n_shingles // PART_SHINGLES))

    def run(batches):
        by: dict[int, list[bytes]] = {}
        found = []
        for x in batches:  # a task may hold several p; it takes one at a time, and names each family once for all of them
            for p, blob in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                by.setdefault(p, []).append(blob)
        for p in list(by):
            parts_of = [_unpack(b) for b in by.pop(p)]
            keys = np.concatenate([x[0] for x in parts_of])
            node, first, inverse = np.unique(keys.view([("a", np.int64), ("b", np.int64)]).ravel(), return_index=True, return_inverse=True)
            usual = np.concatenate([x[1] for x in parts_of])[first]
            both = np.empty(sum(len(x[3]) for x in parts_of), _U)  # signature and node; the only array of this length but for masks
            at = base = 0
            for k, _, count, sig in parts_of:
                own = np.repeat(inverse[base : base + len(k)], count)
                both[at : at + len(sig)] = (sig.astype(_U) << _U(32)) | own.astype(_U)
                at, base = at + len(sig), base + len(k)
            del parts_of, keys
            both.sort()
            both = both[np.r_[True, both[1:] != both[:-1]]]
            twin = (both[1:] >> _U(32)) == (both[:-1] >> _U(32))
            both = both[np.r_[False, twin] | np.r_[twin, False]]
            if not len(both):
                continue
            sig, own = both >> _U(32), (both & _U(0xFFFFFFFF)).astype(np.int64)
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            popular = np.bincount(own, np.repeat(size, size).astype(float), len(node))
            group = np.repeat(np.arange(len(start)), size)
            order = np.lexsort((own, -popular[own], -usual[own], group))
            pair = np.unique((own[order][start][group] << 32) | own)
            pair = _hand_over(pair, len(node))
            found.append((node[pair & 0xFFFFFFFF], node[pair >> 32]))
        if found:
            m, c = (np.concatenate(x) for x in zip(*found, strict=True))
            node, at = np.unique(np.concatenate([m, c]), return_inverse=True)
            pair = _hand_over(np.unique((at[len(m) :] << 32) | at[: len(m)]), len(node))
            for i in range(0, len(pair), 100_000):
                m, c = node[pair[i : i + 100_000] & 0xFFFFFFFF], node[pair[i : i + 100_000] >> 32]
                yield pa.record_batch([pa.array(v) for v in (m["a"], m["b"], c["a"], c["b"])], ["a", "b", "ca", "cb"])

    packed = _packed(docs, frequent, parts).repartition(parts, "p")
    return packed.mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def _hand_over(pair: np.ndarray, n_nodes: int) -> np.ndarray:
    """Pairs (centre << 32 | member) after each centre has handed its family over to the largest one that it is in."""
    c, x = pair >> 32, pair & 0xFFFFFFFF
    n = np.bincount(c, minlength=n_nodes)
    here = np.flatnonzero(n[x] > 0)  # rows whose member is a centre; it is in its own family too
    best = here[np.lexsort((-c[here], n[c[here]], x[here]))]
    last = np.r_[x[best][1:] != x[best][:-1], True]
    root = np.zeros(n_nodes, np.int64)
    root[x[best][last]] = c[best][last]
    return np.unique((root[c] << 32) | x)


def _filter(nodes: DataFrame) -> bytes:
    """A bit for the hash of each id: a Bloom filter of fixed size, so that other documents aren't shuffled."""
    h = nodes.select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER)).alias("h"))
    rows = h.groupBy(F.expr("cast(h div 32 AS int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 AS int))")).alias("x")).toPandas()
    out = np.zeros(1 << FILTER - 5, np.uint32)
    out[rows["w"].to_numpy()] = rows["x"].to_numpy().astype(np.uint32)
    return out.tobytes()


def _merged(members: DataFrame) -> DataFrame:
    """Families (c, id) after each centre has handed its family over to the largest one that it is in. No pair is lost: families only grow."""
    sized = members.join(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c")
    of = sized.join(members.select(F.col("c").alias("id")).distinct(), "id").groupBy("id").agg(F.max_by("c", F.struct("n", "c")).alias("root"))
    return members.join(of.withColumnRenamed("id", "c"), "c").select(F.col("root").alias("c"), "id").distinct()


def _pack(s: np.ndarray) -> bytes:
    """48 bits of each hash; what is lost can't turn a link (chance collision within a pair: below 1e-8)."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _sets_of(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(_U).ravel()


def intersections(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by matrix products over the hashes that occur twice, a slice at a time."""
    sets = [*rows, *cols]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    at, owner = (np.cumsum(n > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out, step = np.zeros((len(rows), len(cols))), 1 << 13
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        i, j = np.searchsorted(at, [lo, lo + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[i:j], at[i:j] - lo] = 1
        out += x[: len(rows)] @ x[len(rows) :].T
    return out.astype(np.int64)


def profile(s: np.ndarray) -> bytes:
    """Size, and how many hashes fall into each of BUCKETS ranges (255 at most)."""
    n = np.bincount((s >> _U(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS)
    return np.int64(len(s)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes()


def may_link(rows: list[bytes], cols: list[bytes]) -> np.ndarray:
    """False only where two profiles prove a pair unlinked: their L1 distance is at most the symmetric difference."""
    read = lambda x: (np.array([np.frombuffer(r, np.int64, 1)[0] for r in x]), np.stack([np.frombuffer(r, np.uint8, BUCKETS, 8) for r in x]))
    (n, p), (m, q) = read(rows), read(cols)
    gap = np.empty((len(n), len(m)), np.int64)
    for i, x in enumerate(p):
        gap[i] = (np.maximum(q, x) - np.minimum(q, x)).sum(1, dtype=np.uint32)
    return gap * (100 + SHARE) <= (n[:, None] + m[None, :]) * (100 - SHARE)


def _with_sets(need: DataFrame, docs: DataFrame, pack=_pack) -> DataFrame:
    """need with the packed set s of each id. An id with several texts has a row for each; it is one document."""
    held = ship(docs.sparkSession, _filter(need), 1 << FILTER - 3)

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for x in pieces(batches):
            h = x.column(3).to_numpy()
            y = x.filter(pa.array(bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1))
            if y.num_rows:
                yield pa.record_batch([y.column(0), pa.array([pack(shingles(t)) for t in y.column(2).to_pylist()], pa.binary())], ["id", "s"])

    sets = _ids(docs).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER))).mapInArrow(run, "id long, s binary")
    return need.join(sets, "id")


def _read(batches, unpack=_sets_of) -> tuple[list[list], list]:
    """Columns but s as lists, and s unpacked."""
    cols, sets = None, []
    for x in pieces(batches):
        got = [x.column(n).to_pylist() for n in x.schema.names if n != "s"]
        cols = got if cols is None else [p + q for p, q in zip(cols, got, strict=True)]
        sets += [unpack(r) for r in x.column("s").to_pylist()]
    return cols, sets


def _linked(rows, cols) -> np.ndarray:
    shared = intersections(rows, cols)
    total = np.array([len(x) for x in rows])[:, None] + np.array([len(x) for x in cols])[None, :] - shared
    return 100 * shared >= SHARE * total


def family_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) of all links within each centre's family (c, id), for families of at most FAMILY members.

    Profiles, a tenth of the sets' bytes, first leave out the members that can't link with any other.
    """

    def some(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, ids), profiles = _read(batches, bytes)
        ids = np.array(ids)
        ok = may_link(profiles, profiles) & (ids[:, None] != ids[None, :])
        keep = np.unique(ids[ok.any(1)])
        yield pa.record_batch([pa.array(np.full(len(keep), key[0].as_py(), np.int64)), pa.array(keep)], ["c", "id"])

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, ids), sets = _read(batches)
        i, j = np.nonzero(np.triu(_linked(sets, sets), 1))
        ids = np.array(ids)
        u, v = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        yield pa.record_batch([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    left = cut(_with_sets(members.select("c", "id"), docs, profile).select("c", "id", "s").groupBy("c").applyInArrow(some, "c long, id long"))
    return _with_sets(left, docs).select("c", "id", "s").groupBy("c").applyInArrow(compare, "u long, v long")


def star_overlaps(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(c, id, shared, total): each member against its centre, in chunks, so that a popular centre is many tasks."""
    dealt = members.filter("id <> c").select("c", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FAMILY)).alias("chunk"), "id")
    need = dealt.unionByName(dealt.select("c", "chunk", F.col("c").alias("id")).distinct())

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (centre, _, ids), sets = _read(batches)
        mid = [s for c, i, s in zip(centre, ids, sets, strict=True) if c == i]
        rest = [(i, s) for c, i, s in zip(centre, ids, sets, strict=True) if c != i]
        out = [(i, int(len(np.intersect1d(m, s, assume_unique=True))), len(m) + len(s)) for i, s in rest for m in mid]
        ids, n, sizes = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))
        yield pa.record_batch([pa.array(np.full(len(ids), key[0].as_py(), np.int64)), pa.array(ids), pa.array(n), pa.array(sizes - n)], ["c", "id", "shared", "total"])

    return _with_sets(need, docs).select("c", "chunk", "id", "s").groupBy("c", "chunk").applyInArrow(compare, "c long, id long, shared long, total long")


def outsider_candidates(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): members outside their centre's component, each with the members of other components that it may link with.

    members: c, id, k (component), d (distance from the centre), out. Members are dealt into blocks of
    profiles; each pair of blocks with outsiders is a task. Left out are pairs whose profiles, or whose
    distances from the centre, prove them unlinked.
    """
    n = members.groupBy("c").agg(F.ceil(F.count_if("out") / PROFILES).alias("no"), F.ceil(F.count_if(~F.col("out")) / PROFILES).alias("ni")).filter("no > 0")
    m = members.join(n, "c").withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("out"), F.col("no")).otherwise(F.col("ni"))))
    to = lambda column: F.explode(F.when(F.col(column) > 0, F.sequence(F.lit(0).cast("long"), F.col(column) - 1)))
    cols = ["c", "id", "k", "d", "out", "b"]
    inner = m.filter("not out").select(*cols, to("no").alias("p")).select(*cols, "p", F.col("b").alias("q"), F.lit(False).alias("same"))
    outer = m.filter("out").select(*cols, "no", to("ni").alias("q")).select(*cols, F.col("b").alias("p"), "q", F.lit(False).alias("same"))
    twins = m.filter("out").select(*cols, to("no").alias("x")).select(*cols, F.least("b", "x").alias("p"), F.greatest("b", "x").alias("q"), F.lit(True).alias("same"))
    need = inner.unionByName(outer).unionByName(twins)

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, ids, k, d, out, *_), sets = _read(batches, bytes)
        ids, k, d, out = np.array(ids), np.array(k), np.array(d), np.array(out)
        rows = np.flatnonzero(out)
        cols = rows if key[3].as_py() else np.flatnonzero(~out)
        if not len(rows) or not len(cols):
            return
        ok = may_link([sets[i] for i in rows], [sets[i] for i in cols]) & (k[rows][:, None] != k[cols][None, :])
        ok &= np.abs(d[rows][:, None] - d[cols][None, :]) <= 1 - SHARE / 100 + 1e-9
        i, j = np.nonzero(ok)
        u, v = ids[rows[i]], ids[cols[j]]
        yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return _with_sets(need, docs, profile).select(*cols, "p", "q", "same", "s").groupBy("c", "p", "q", "same").applyInArrow(compare, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every linked id: the smallest id reachable. Each round halves distances; state is checkpointed."""
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("comp")))
    while True:
        around = both.join(state.select(F.col("id").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = state.join(around, F.col("id") == F.col("u")).select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        new = cut(step.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        if new.filter("was <> comp").isEmpty():
            return new.select("id", "comp")
        state = new.select("id", "comp")


def assign(docs: DataFrame) -> DataFrame:
    """id, doc_id, n_shingles, component_id (its smallest doc_id) and comp (its smallest id; null for an empty set) for every row of docs."""
    rows = cut(digests(docs))
    full = rows.filter("n_shingles > 0")
    classes = cut(full.groupBy("a", "b").agg(F.min("id").alias("cls"), F.min("doc_id").alias("least"), F.min("n_shingles").alias("size")))
    n_shingles = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = families(docs, frequent_shingles(docs), n_shingles)
    name = lambda df, a, b, c, size: df.join(classes.select(F.col("a").alias(a), F.col("b").alias(b), F.col("cls").alias(c), F.col("size").alias(size)), [a, b])
    groups = name(name(groups, "a", "b", "id", "nx"), "ca", "cb", "c", "nc")
    # an id with several texts is one node from here on
    members = cut(_merged(cut(groups.select("c", "id").distinct())))
    members = cut(members.join(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c"))
    big = members.filter(F.col("n") > FAMILY)
    links = cut(family_links(members.filter(F.col("n") <= FAMILY), docs).distinct())
    if big.isEmpty():
        comp = components(links)
    else:
        star = cut(star_overlaps(big, docs).groupBy("c", "id").agg(F.max(F.struct(F.col("shared") / F.col("total"), "shared", "total")).alias("m")).select("c", "id", "m.shared", "m.total"))
        links = cut(links.unionByName(star.filter(100 * F.col("shared") >= SHARE * F.col("total")).select(F.col("c").alias("u"), F.col("id").alias("v"))).distinct())
        comp = components(links)
        of = lambda df, i, k: df.join(comp.select(F.col("id").alias(i), F.col("comp").alias(k)), i, "left").withColumn(k, F.coalesce(k, i))
        placed = of(of(star, "id", "k"), "c", "kc").select("c", "id", "k", (1 - F.col("shared") / F.col("total")).alias("d"), (F.col("k") != F.col("kc")).alias("out"))
        pairs = outsider_candidates(placed, docs).distinct().select(F.col("u").alias("c"), F.col("v").alias("id"))
        pairs = cut(pairs.join(pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c"))
        late = star_overlaps(pairs, docs).filter(100 * F.col("shared") >= SHARE * F.col("total")).select(F.col("c").alias("u"), F.col("id").alias("v")).distinct()
        late = cut(late)
        if not late.isEmpty():
            links = cut(links.unionByName(late).distinct())
            comp = components(links)
    known = classes.join(comp, F.col("cls") == F.col("id"), "left").select("a", "b", "cls", "least", F.coalesce("comp", "cls").alias("comp"))
    best = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = known.join(best, "comp").select("a", "b", "component_id", "comp")
    # an empty set's digest is no class, so such rows keep their own id
    out = rows.join(named, ["a", "b"], "left")
    return out.select("id", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    return assign(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row per component of texts: that of its smallest doc_id (null last), then the smallest hash of a text, then the smallest in all columns.

    A node is a text here, so different texts of a repeated doc_id both stay. Rows with an empty set all stay. Only texts of rows
    that may be dropped are shuffled.
    """
    t, d = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.col("doc_id").cast("long")
    found = assign(docs.select("doc_id", "text", t.alias("__node"))).filter("comp is not null")
    rows = cut(found.groupBy("comp", "doc_id", F.col("id").alias("t")).agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    groups = rows.groupBy("comp").agg(first, F.sum("n").alias("size")).filter("size > 1").drop("size")
    stays = (F.col("t") == F.col("first.t")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    key = [F.col("t").alias("__t"), F.coalesce("doc_id", F.lit(0)).alias("__d"), F.col("doc_id").isNull().alias("__n")]
    judged = cut(rows.join(groups, "comp").select(*key, stays.alias("__stays"), "n").filter("not __stays or n > 1").drop("n"))
    names, on = docs.columns, ["__t", "__d", "__n"]
    h = F.xxhash64(*on)
    some, rest = part_by_keys(docs.withColumns({"__t": t, "__d": F.coalesce(d, F.lit(0)), "__n": d.isNull()}), h, judged, h)
    some = some.join(judged, on, "left")
    out = rest.select(*names).unionByName(some.filter("__stays is null").select(*names))
    if not judged.filter("__stays").isEmpty():
        order = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        one = some.filter("__stays").groupBy(*on).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("x"))
        out = out.unionByName(one.select("x.*"))
    return out


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j + 1 : j + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS j FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
