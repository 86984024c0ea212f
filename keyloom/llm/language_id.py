"""Language ID by a bidirectional gated recurrent network over bytes (operator 2).

A text is its bytes, lower-cased, with every run of ASCII whitespace as one blank. A forward and a backward GRU read it
and a softmax over both hidden states labels every position. Long texts are read in windows of WINDOW positions that overlap
their neighbours by CONTEXT on both sides, so that both states are carried into the positions that a window labels; windows of
all texts of a batch advance together. Every position of every text is labelled once; a document's probability is
the tempered product over its positions.

The network is trained in numpy on the driver, by backpropagation through time with Adam, on random windows of a
bounded sample of whole texts: at most SAMPLE_DOCS different texts per language, of SAMPLE_CHARS characters together,
chosen by hash among documents outside the held-out fold. Texts longer than SAMPLE_CHARS aren't learned from.

Defined results: null text or text without a letter gives ``und`` with score 0; with nothing to learn from,
every document is ``und``; null lang is not learned from; a null doc_id belongs to the fold of the empty
text; repeated rows get equal results; other columns are passed on by identify() and ignored by the query.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import fold_of, pieces, table

FOLDS, HELD_OUT = 3, 1
SAMPLE_DOCS, SAMPLE_CHARS = 250, 2_000_000
#: Documents and characters over all languages together.
SAMPLE_TOTAL, SAMPLE_TOTAL_CHARS = 20_000, 64_000_000
HIDDEN = 8
#: Positions that a window labels, and positions on each side that it reads besides.
WINDOW, CONTEXT = 448, 32
#: Windows of training: their positions, and how many a step; steps.
PIECE, BATCH, STEPS = 64, 256, 400
#: Windows that the network reads at once.
BLOCK = 1024
#: A position's share in the evidence; neighbouring positions say much the same.
TEMPER = 0.1
UND = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def sample(docs: DataFrame) -> DataFrame:
    """(lang, h, text) of a bounded sample of whole texts of the training fold; the top-k by hash is taken per task before the shuffle of a language."""
    train = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).withColumn("h", F.xxhash64("text"))
    # copies of a text count once; the texts are read again for the chosen ones only
    size = train.select("lang", "h", F.length("text").alias("size")).distinct()
    by = Window.partitionBy("lang").orderBy("h")
    few = size.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= SAMPLE_DOCS)
    few = few.withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= SAMPLE_CHARS)
    few = few.orderBy("h", "lang").limit(SAMPLE_TOTAL)
    upto = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("h", "lang").rowsBetween(Window.unboundedPreceding, 0))
    chosen = few.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_TOTAL_CHARS).select("lang", "h")
    found = train.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text")
    return found.dropDuplicates(["lang", "h"]).orderBy("h", "lang")


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes by position (0 after the end), and lengths."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    x = np.zeros((len(pieces), int(n.max())), np.uint8)
    x[np.arange(x.shape[1]) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    return x, n


class ByteGru:
    """Weights: for each direction E (256 x 3H: update, reset, candidate), U (H x 3H), b (H, candidate's recurrent bias); output V (2H x L), c (L)."""

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray]):
        self.labels, self.w = labels, weights

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGru:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["E" + d] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            w["U" + d] = (r.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            w["b" + d] = np.zeros(hidden, np.float32)
        w["V"] = (r.normal(0, 1, (2 * hidden, len(labels))) / np.sqrt(2 * hidden)).astype(np.float32)
        w["c"] = np.zeros(len(labels), np.float32)
        return cls(labels, w)

    def _run(self, d: str, x: np.ndarray, n: np.ndarray, keep: bool):
        """Hidden states (T, B, H) in the order of the text. Windows are sorted by falling length, so step t has the first alive[t]."""
        T, B, H = x.shape[1], x.shape[0], self.w["b" + d].size
        # a gate at a time, so that what is added and multiplied lies in one piece
        E = self.w["E" + d].reshape(256, 3, H).transpose(1, 0, 2).copy()
        U = self.w["U" + d].reshape(H, 3, H).transpose(1, 0, 2).copy()
        b, at = self.w["b" + d], x.T.astype(np.intp)
        states = np.zeros((T, B, H), E.dtype)
        h, trace = np.zeros((B, H), E.dtype), []
        alive = np.searchsorted(-n, -np.arange(T), side="left")  # windows longer than t
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            m = alive[t]
            prev = h[:m]
            a, g = E.take(at[t, :m], axis=1), np.matmul(prev, U)
            zr = a[:2]
            zr += g[:2]
            zr *= 0.5
            np.tanh(zr, out=zr)  # the logistic function by way of tanh
            zr *= 0.5
            zr += 0.5
            z, r = zr
            q = g[2]
            q += b
            k = r * q
            k += a[2]
            np.tanh(k, out=k)
            new = prev - k
            new *= z
            new += k
            if keep:
                trace.append((t, m, prev.copy(), z, r, q, k))
            h[:m] = new
            states[t, :m] = new
        return states, trace

    def evidence(self, x: np.ndarray, n: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(B, L): sum of the label log probabilities of positions first to end of each window; windows by falling length."""
        H = self.w["bf"].size
        v = self._run("f", x, n, False)[0] @ self.w["V"][:H]
        v += self._run("b", x, n, False)[0] @ self.w["V"][H:]
        v += self.w["c"]
        v -= v.max(axis=2, keepdims=True)
        v -= np.log(np.exp(v).sum(axis=2, keepdims=True))
        at = np.arange(x.shape[1])[:, None]
        v *= ((at >= first) & (at < end))[:, :, None]
        return v.sum(0, dtype=np.float64)

    def gradients(self, x, n, y):
        """Loss per position and gradients of all weights, by backpropagation through time."""
        H, g = self.w["bf"].size, {k: np.zeros_like(v) for k, v in self.w.items()}
        sf, tf = self._run("f", x, n, True)
        sb, tb = self._run("b", x, n, True)
        s = np.concatenate([sf, sb], axis=2)
        inside = (np.arange(x.shape[1])[:, None] < n).astype(np.float32)[:, :, None] / n.sum()
        lp = _log_softmax(s @ self.w["V"] + self.w["c"])
        hot = np.eye(len(self.labels), dtype=np.float32)[y]
        loss = -float((lp * hot * inside).sum())
        do = (np.exp(lp) - hot) * inside
        g["V"] = s.reshape(-1, 2 * H).T @ do.reshape(-1, do.shape[2])
        g["c"] = do.sum((0, 1))
        ds = do @ self.w["V"].T
        for d, trace, part in (("f", tf, ds[:, :, :H]), ("b", tb, ds[:, :, H:])):
            U, dh = self.w["U" + d], np.zeros((len(n), H), np.float32)
            seen, into = [], []
            for t, m, prev, z, r, q, k in reversed(trace):
                dn = dh[:m] + part[t, :m]
                dk = dn * (1 - z) * (1 - k * k)
                dz = dn * (prev - k) * z * (1 - z)
                dr = dk * q * r * (1 - r)
                dq = dk * r
                da = np.concatenate([dz, dr, dk], axis=1)
                dg = np.concatenate([dz, dr, dq], axis=1)
                seen.append(x[:m, t])
                into.append(da)
                g["U" + d] += prev.T @ dg
                g["b" + d] += dq.sum(0)
                dh[:m] = dn * z + dg @ U.T
            seen, into = np.concatenate(seen), np.concatenate(into)
            for j in range(3 * H):
                g["E" + d][:, j] = np.bincount(seen, into[:, j], 256)
        return loss, g

    def train(self, texts: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> ByteGru:
        """texts: a pool for each label; a batch has random windows, as many of each label."""
        r = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            y = r.integers(0, len(texts), batch)
            chosen = []
            for c in y:
                t = texts[c][r.integers(len(texts[c]))]
                at = r.integers(0, max(1, len(t) - PIECE + 1))
                chosen.append(t[at : at + PIECE])
            order = np.argsort([-len(w) for w in chosen], kind="stable")
            x, n = _padded([chosen[i] for i in order])
            _, g = self.gradients(x, n, y[order])
            lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                self.w[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Label and probability of each text."""
        windows, owner, first, end = [], [], [], []
        for i, t in enumerate(texts):
            if t and self.labels and _has_letter(t):
                t = plain(t)
                for at in range(0, len(t), WINDOW):
                    lo = max(0, at - CONTEXT)
                    windows.append(t[lo : at + WINDOW + CONTEXT])
                    owner.append(i)
                    first.append(at - lo)
                    end.append(min(at + WINDOW, len(t)) - lo)
        total = np.zeros((len(texts), max(1, len(self.labels))))
        order = np.argsort([-len(w) for w in windows], kind="stable")
        owner, first, end = (np.array(v, np.int64) for v in (owner, first, end))
        for i in range(0, len(windows), BLOCK):
            part = order[i : i + BLOCK]
            x, n = _padded([windows[j] for j in part])
            np.add.at(total, owner[part], self.evidence(x, n, first[part], end[part]))
        read = np.bincount(owner, minlength=len(texts)) > 0
        p = total * TEMPER
        p = np.exp(p - p.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = p[np.arange(len(texts)), best] / p.sum(axis=1)
        return [self.labels[b] if r else UND for b, r in zip(best, read, strict=True)], np.where(read, score, 0.0).tolist()


def _log_softmax(v):
    v = v - v.max(axis=-1, keepdims=True)
    return v - np.log(np.exp(v).sum(axis=-1, keepdims=True))


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(docs: DataFrame) -> ByteGru:
    pools: dict[str, list[bytes]] = defaultdict(list)
    for lang, _, text in sample(docs).collect():
        if t := plain(text.encode()):
            pools[lang].append(t)
    labels = sorted(pools)
    net = ByteGru.fresh(labels)
    return net.train([pools[k] for k in labels]) if len(labels) > 1 else net


def identify(docs: DataFrame, net: ByteGru | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with label and probability, in columns of these names (earlier ones are replaced)."""
    net = net or fit(docs)
    own = [c for c in docs.columns if c not in names]
    # a copy of text as bytes, so that nothing is decoded
    df = docs.select(*own, F.col("text").cast("binary").alias("__bytes"))

    def run(batches):
        for b in pieces(batches):
            labels, scores = net.documents(b.column(b.num_columns - 1).to_pylist())
            yield pa.record_batch([*b.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], *names])

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], *added]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs)
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for b in pieces(batches):
            labels, scores = net.documents(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = slim.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
