"""LM scoring by a hidden Markov language model (operator 1).

Words are emitted in two steps: a latent state emits one of a bounded number of word classes, and the class
emits the word in proportion to its smoothed training count. The HEAD words most frequent in training are
classes of their own, every other word's class is a hash of its last bytes, and the end token has a class.
Nothing that decides a score comes from held-out texts.

1. Words are counted over all documents: two Counters per task, flushed when full, then summed by
   shuffle on the word. The table of counts grows with the corpus and stays distributed; only two
   bounded tables are broadcast: words frequent in training, which may be classes, and words frequent
   anywhere, which so can't skew the join of step 2.
2. One pass encodes every document as class numbers and looks up the broadcast words; the other words
   leave it as (document, word, occurrences) rows and meet their counts in a shuffle join.
3. Baum-Welch: every task runs scaled forward-backward over the encoded training documents and returns
   one row of expected counts; these are summed, and the next round starts from them, until a round
   raises the log likelihood of a token by less than TOLERANCE.
4. The scaled forward recursion gives each document's exact likelihood under the trained model.

A sequence longer than SEGMENT is read in segments at once, each from every state; the products of these
give the exact distribution before each segment and the exact weight of what follows it, so memory is bounded
and nothing is cut.

Defined results: null or empty text is the end token alone; a null doc_id belongs to the fold of the
empty text; rows that repeat are scored each; without training tokens the counts are zero and states
stay at their start; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, fold_of, pieces, ship, table

FOLDS, HELD_OUT = 5, 1
STATES = 6
#: Frequent words that are classes; classes of the others; then one class for the end token.
HEAD, SHAPES = 1024, 512
END = HEAD + SHAPES
CLASSES = END + 1
#: Frequent words that are looked up without a shuffle, and a bound for their bytes.
KNOWN, MAX_BYTES = 100_000, 64 << 20
#: Baum-Welch ends when a round gains less than this (log10 of the probability of a token), or after so many rounds.
TOLERANCE, ROUNDS = 0.01, 30
#: Tokens of a sequence that are read as one segment.
SEGMENT = 1024
#: Words counted per task before it passes them on; tokens per forward-backward block.
FLUSH, BLOCK = 400_000, 1_000_000
#: The token that ends every text; no word can hold a blank.
END_WORD = b" "


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (occurrences in all documents), c (in training documents). The end token is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, held = Counter(), Counter()

        def rows():
            words = [*train, *(w for w in held if w not in train)]
            c = np.fromiter(map(train.__getitem__, words), np.int64, len(words))
            n = c + np.fromiter(map(held.__getitem__, words), np.int64, len(words))
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(n), pa.array(c)], ["word", "n", "c"])

        for b in pieces(batches):
            for out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                words.append(END_WORD)
                (held if out else train).update(words)
                if len(train) + len(held) > FLUSH:
                    yield rows()
                    train, held = Counter(), Counter()
        if train or held:
            yield rows()

    return _slim(docs).select("held_out", "text").mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))


def shape_class(word: bytes) -> int:
    return HEAD + xxhash.xxh3_64_intdigest(word[-3:]) % SHAPES


def _shape_mass(counts: DataFrame) -> DataFrame:
    """k, x: sum of c + 0.5 over the words of each shape class; at most SHAPES rows."""

    def run(batches):
        x = np.zeros(CLASSES)
        for b in batches:
            k = np.fromiter(map(shape_class, b.column(0).to_pylist()), np.int64, b.num_rows)
            x += np.bincount(k, b.column(1).to_numpy() + 0.5, CLASSES)
        k = np.flatnonzero(x)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(x[k])], ["k", "x"])

    return counts.filter("c > 0").select("word", "c").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x"))


class Lookup:
    """Of the known words: class and training count. The words most frequent in training have classes of their own."""

    def __init__(self, rows: list[tuple[bytes, int]], head: int):
        """rows: (word, training count), among them all words whose training count is head or more; others can't be classes."""
        self.entry: dict[bytes, tuple[int, int]] = {}
        rank = 0
        for word, c in sorted(rows, key=lambda r: (-r[1], r[0])):
            if word == END_WORD:
                self.entry[word] = (END, c)
            elif rank < HEAD and c >= max(head, 1):
                self.entry[word] = (rank, c)
                rank += 1
            else:
                self.entry[word] = (shape_class(word), c)


class _Encoder(dict):
    """word -> index; words that aren't looked up are added as they come, until they are forgotten."""

    def __init__(self, lookup: Lookup):
        super().__init__(zip(lookup.entry, range(len(lookup.entry)), strict=True))
        entry = np.array(list(lookup.entry.values()), np.int64).reshape(-1, 2)
        self.known = len(entry)
        self.cls, self.log, self.hit = entry[:, 0].astype(np.uint16), np.log10(entry[:, 1] + 0.5), (entry[:, 1] > 0).astype(np.int8)
        self.new: list[bytes] = []

    def __missing__(self, w):
        self.new.append(w)
        out = self[w] = self.known + len(self.new) - 1
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By index: class, log10(c + 0.5), and whether the word is known, -1 if not looked up yet."""
        n = len(self.new)
        cls = np.fromiter(map(shape_class, self.new), np.uint16, n)
        return np.concatenate([self.cls, cls]), np.concatenate([self.log, np.zeros(n)]), np.concatenate([self.hit, np.full(n, -1, np.int8)])

    def forget(self) -> None:
        for w in self.new:
            del self[w]
        self.new = []


def encode(docs: DataFrame, lookup: Lookup) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known and log_sum (of looked-up words), classes (uint16 numbers), rest (words), times."""
    held_lookup = ship(docs.sparkSession, pickle.dumps(lookup), MAX_BYTES)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = _Encoder(pickle.loads(held_lookup.value))
        for b in pieces(batches):
            ids = []
            for text in b.column(2).to_pylist():
                words = (text or b"").lower().split()
                words.append(END_WORD)
                ids.append(np.fromiter(map(e.__getitem__, words), np.int32, len(words)))
            cls, log, hit = e.tables()
            known, total, classes, rest, times = [], [], [], [], []
            for x in ids:
                h = hit[x]
                known.append(int((h == 1).sum()))
                total.append(float(log[x].sum()))
                classes.append(cls[x].tobytes())
                words, n = np.unique(x[h < 0], return_counts=True)
                rest.append([e.new[i] for i in (words - e.known).tolist()])
                times.append(n.tolist())
            e.forget()
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(total), pa.array(classes, pa.binary()), pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "log_sum", "classes", "rest", "times"],
            )

    out = _slim(docs).mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_sum double, classes binary, rest array<binary>, times array<bigint>")
    return out.withColumn("uid", F.monotonically_increasing_id())


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start (K), move (K, K), emit (K, CLASSES): rows sum to 1."""
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def fresh(cls, totals: np.ndarray, states: int = STATES, seed: int = 3) -> Hmm:
        """Emissions near the class frequencies, sticky moves."""
        r = np.random.default_rng(seed)
        emit = (totals + 1.0) * np.exp(r.normal(0, 0.5, (states, len(totals))))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def sweep(self, sequences: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state distribution at the end, log10 probability) of each sequence, from begin, the states' probabilities at its first token.

        The sequences advance together.
        """
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        n = np.array([len(sequences[i]) for i in order])
        last, out = np.empty((len(n), len(self.start))), np.zeros(len(n))
        table = np.ascontiguousarray(self.emit.T)
        for part in _blocks(n):
            which, m = order[part], n[part]
            flat, first, alive = _by_step([sequences[i] for i in which], m)
            total, alpha = np.zeros(len(m)), begin[which]
            for t in range(int(m[0])):
                k = alive[t]
                if t:
                    alpha[:k] = alpha[:k] @ self.move
                now = alpha[:k] * table[flat[first[t] : first[t] + k]]
                scale = now.sum(1)
                alpha[:k] = now / scale[:, None]
                total[:k] += np.log10(scale)
            last[which], out[which] = alpha, total
        return last, out

    def _products(self, segments: list[np.ndarray]) -> np.ndarray:
        """(segments, K, K): the state at the end of each segment and the probability of its tokens, for each state before it; each scaled, and log10 of the scale."""
        K = len(self.start)
        last, log = self.sweep([s for s in segments for _ in range(K)], np.tile(self.move, (len(segments), 1)))
        log = log.reshape(-1, K)
        top = log.max(1)
        return last.reshape(-1, K, K) * 10.0 ** (log - top[:, None])[:, :, None], top

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each class sequence."""
        heads, rest, owner = [], [], []
        for i, s in enumerate(sequences):
            heads.append(s[:SEGMENT])
            for at in range(SEGMENT, len(s), SEGMENT):
                rest.append(s[at : at + SEGMENT])
                owner.append(i)
        state, out = self.sweep(heads, np.tile(self.start, (len(heads), 1)))
        if rest:
            for i, product, log in zip(owner, *self._products(rest), strict=True):
                now = state[i] @ product
                out[i] += np.log10(now.sum()) + log
                state[i] = now / now.sum()
        return out

    def segmented(self, sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(segments, starts, before, after) of sequences.

        starts: whether a segment begins its text; before: the states' distribution at the token before it; after: the weight of what
        follows it by state at its last token, scaled so that its mean under the distribution there is 1.
        """
        K = len(self.start)
        segments, starts = [], []
        for s in sequences:
            for at in range(0, len(s), SEGMENT):
                segments.append(s[at : at + SEGMENT])
                starts.append(at == 0)
        starts = np.array(starts, bool)
        before, after = np.zeros((len(segments), K)), np.ones((len(segments), K))
        runs = np.flatnonzero(starts)
        long = [(i, j) for i, j in zip(runs.tolist(), [*runs[1:].tolist(), len(segments)], strict=True) if j - i > 1]
        if long:
            inner = [x for i, j in long for x in range(i + 1, j)]
            products = dict(zip(inner, self._products([segments[x] for x in inner])[0], strict=True))
            ends = self.sweep([segments[i] for i, _ in long], np.tile(self.start, (len(long), 1)))[0]
            for (i, j), state in zip(long, ends, strict=True):
                states = [state]
                for x in range(i + 1, j):
                    before[x] = states[-1]
                    state = states[-1] @ products[x]
                    states.append(state / state.sum())
                weight = np.ones(K)
                for x in range(j - 1, i, -1):
                    weight = products[x] @ weight
                    weight /= states[x - 1 - i] @ weight
                    after[x - 1] = weight
        return segments, starts, before, after

    def expect(self, sequences: list[np.ndarray]):
        """Expected counts of starts, moves and emissions, and the log10 likelihood."""
        K = len(self.start)
        s0, mv, em, ll = np.zeros(K), np.zeros((K, K)), np.zeros((K, self.emit.shape[1])), 0.0
        table = np.ascontiguousarray(self.emit.T)
        segments, starts, before, after = self.segmented(sequences)
        order = np.argsort([-len(s) for s in segments], kind="stable")
        n = np.array([len(segments[i]) for i in order])
        for part in _blocks(n):
            which, m = order[part], n[part]
            flat, first, alive = _by_step([segments[i] for i in which], m)
            b = table[flat]
            alpha, scale = np.empty((len(flat), K)), np.empty(len(flat))
            begin = np.where(starts[which][:, None], self.start, before[which] @ self.move)
            for t in range(int(m[0])):
                k, at = alive[t], first[t]
                prev = begin if t == 0 else alpha[first[t - 1] : first[t - 1] + k] @ self.move
                a = prev * b[at : at + k]
                c = a.sum(1)
                alpha[at : at + k] = a / c[:, None]
                scale[at : at + k] = c
            ll += float(np.log10(scale).sum())
            beta, ends = np.ones((0, K)), after[which]
            for t in range(int(m[0]) - 1, -1, -1):
                k, at = alive[t], first[t]
                full = ends[:k].copy()
                if len(beta):
                    nxt = len(beta)
                    w = b[first[t + 1] : first[t + 1] + nxt] * beta / scale[first[t + 1] : first[t + 1] + nxt, None]
                    mv += alpha[at : at + nxt].T @ w
                    full[:nxt] = w @ self.move.T
                beta = full
                alpha[at : at + k] *= beta  # the states' probabilities; alpha isn't needed there any more
            k = len(m)
            mv += before[which].T @ (b[:k] * beta / scale[:k, None])  # into a segment; nothing stands before a start
            s0 += alpha[:k][starts[which]].sum(0)
            for j in range(K):
                em[j] += np.bincount(flat, alpha[:, j], em.shape[1])
        return s0, mv * self.move, em, ll

    @classmethod
    def from_counts(cls, s0, mv, em) -> Hmm:
        """Maximum likelihood with a little smoothing."""
        s0, mv = s0 + 0.1, mv + 0.1
        em = em + 1e-3 + 0.5 * em.sum(0) / max(em.sum(), 1)
        return cls(s0 / s0.sum(), mv / mv.sum(1, keepdims=True), em / em.sum(1, keepdims=True))


def _blocks(n: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of positions that hold about BLOCK tokens; one long sequence may exceed it."""
    i = 0
    while i < len(n):
        j = i + max(1, int(np.searchsorted(np.cumsum(n[i:]), BLOCK)))
        yield np.arange(i, min(j, len(n)))
        i = j


def _by_step(seqs: list[np.ndarray], n: np.ndarray):
    """Sequences of falling length, transposed: the values at step t are flat[first[t]:][:alive[t]]."""
    top = int(n[0])
    alive = np.searchsorted(-n, -np.arange(top), side="left")
    first = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(int(first[-1]), np.int64)
    at = first[:-1]
    for i, s in enumerate(seqs):
        flat[at[: len(s)] + i] = s
    return flat, first, alive


def train(encoded: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch. What comes to the driver per round is one row of fixed size per partition sum: counts of states x classes."""
    spark = encoded.sparkSession
    fit = encoded.filter("not held_out").select("classes")

    def totals(batches):
        n = np.zeros(CLASSES)
        for b in batches:
            for x in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(x, np.uint16), minlength=CLASSES)
        yield pa.record_batch([pa.array(np.arange(CLASSES), pa.int32()), pa.array(n)], ["k", "x"])

    def total(df: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for k, x in df.groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[k] = x
        return out

    seen = total(fit.mapInArrow(totals, "k int, x double"), CLASSES)
    model, last = Hmm.fresh(seen, states), -np.inf
    for _ in range(rounds if seen.any() else 0):
        held = ship(spark, pickle.dumps(model), MAX_BYTES)

        def expect(batches, held=held):
            model = pickle.loads(held.value)
            K = len(model.start)
            sums = np.zeros(K + K * K + K * CLASSES + 1)
            for b in pieces(batches):
                s0, mv, em, ll = model.expect([np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()])
                sums += np.concatenate([s0, mv.ravel(), em.ravel(), [ll]])
            yield pa.record_batch([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["k", "x"])

        K = len(model.start)
        sums = total(fit.mapInArrow(expect, "k int, x double"), K + K * K + K * CLASSES + 1)
        model = Hmm.from_counts(sums[:K], sums[K : K + K * K].reshape(K, K), sums[K + K * K : -1].reshape(K, CLASSES))
        if sums[-1] - last < tolerance * seen.sum():
            break
        last = sums[-1]
    return model


def _threshold(counts: DataFrame, of: str) -> int:
    """The lowest power of two that at most KNOWN words reach. Only a histogram of powers comes to the driver, so nothing is sorted."""
    power = F.floor(F.log2(of)).cast("int")
    words = {r.p: r.k for r in counts.filter(F.col(of) > 0).groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    p, total = 63, 0
    while p >= 0 and total + words.get(p, 0) <= KNOWN:
        total += words.get(p, 0)
        p -= 1
    return 1 << (p + 1)


def look_up(counts: DataFrame) -> Lookup:
    """The words that may be classes, by training counts alone, and the words that are frequent anywhere."""
    head = _threshold(counts, "c")
    got = counts.filter((F.col("c") >= head) | (F.col("n") >= _threshold(counts, "n")) | (F.col("word") == END_WORD)).select("word", "c").collect()
    return Lookup([(bytes(w), c) for w, c in got], head)


def score(docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """The columns of the query for every row of docs."""
    spark = docs.sparkSession
    counts = cut(count_words(docs))
    n_train, vocab = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    lookup = look_up(counts)
    encoded = cut(encode(docs, lookup))
    model = train(encoded, states, tolerance, rounds)
    # mass of a class: count + 0.5 for each of its words seen in training, and 0.5 for all unseen ones
    mass = np.full(CLASSES, 0.5)
    for k, x in _shape_mass(counts).collect():
        mass[k] += x
    for word, (k, c) in lookup.entry.items():
        if k < HEAD or k == END:  # alone in its class
            mass[k] = c + 0.5
            mass[shape_class(word)] -= (c + 0.5) * (c > 0)
    held = ship(spark, pickle.dumps((model, np.log10(mass))), MAX_BYTES)

    rest = encoded.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    late = rest.join(counts.select("word", "c"), "word", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("late_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("late_known"))

    def forward(batches):
        model, log_mass = pickle.loads(held.value)
        for b in pieces(batches):
            seqs = [np.frombuffer(x, np.uint16) for x in b.column("classes").to_pylist()]
            likely = model.log10_likelihood(seqs) if seqs else np.empty(0)
            spent = [float(log_mass[s].sum()) for s in seqs]
            keep = [n for n in b.schema.names if n != "classes"]
            yield pa.record_batch([*(b.column(n) for n in keep), pa.array(likely - np.array(spent))], [*keep, "forward"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    seen = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "log_sum", "classes").mapInArrow(forward, f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_sum double, forward double")
    logs = F.col("log_sum") + F.coalesce("late_log", F.lit(0.0))
    per_token = F.log10(F.lit(float(n_train)) + 0.5 * (vocab + 1))
    return seen.join(late, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * per_token).alias("base_score"), (logs + F.col("forward")).alias("score"),
    )


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
