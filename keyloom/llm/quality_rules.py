"""Quality rules with risk-controlled thresholds (operator 5, DataFrame functions only).

Three ratios (symbols per word character, duplicate lines per word, repeated words per word) are rules of the form
"reject above a cutoff". SEQUENCE is a fixed order of joint cutoffs of all three, each rejecting what the one before it
rejects and more: the symbol, line and repeat rules are tightened over the grid in TURNS.
Labelled good documents that pass the base rules are the holdout. Per stratum (language), the last joint cutoff of the
sequence is chosen whose false rejections, by any rule, are below alpha by an exact binomial test:
P(Bin(n, alpha) <= k) <= delta / tests. Along the sequence no correction is needed: its order is fixed beforehand and k
only grows, so what passes is a run from its start. tests counts the strata and their pool (Bonferroni), so all
guarantees hold together with confidence 1 - delta. Strata with fewer labels than zero errors would need to pass are told
by that number alone, and make up one stratum, the pool; documents of a language without labels belong to it too.
For these the guarantee is on the pool, not on each of its languages. If nothing passes, nothing is rejected.

Everything about a text is computed inside its row: no shuffle of texts or words.

Defined results: null or blank text has no words, fails the base rule and is not kept; null lang is a
stratum of its own; documents without label are judged, not learned from; rows that repeat a label
count once with the lowest quality; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WS_CHARS, cut, let, table, words

ALPHA = 0.02
DELTA = 0.05
SYMBOLS = "#*$%&|<>"
#: Cutoffs tried by each rule, from lax to strict, in thousandths; OFF rejects nothing, as no ratio exceeds 1.
GRID, OFF = (500, 400, 300, 250, 200, 150, 100, 50, 20), 1_000_000
RULES = ("symbols", "lines", "repeats")
#: How far each rule is tightened in turn, before the next turn.
TURNS = ((100, 100, 300), (50, 50, 200), (20, 20, 20))


def joint_cutoffs(grid=GRID, turns=TURNS) -> tuple[tuple[int, ...], ...]:
    """Cutoffs by rule, each step tightening one rule by a place of the grid."""
    now, out = [OFF] * len(RULES), []
    for turn in turns:
        for r, least in enumerate(turn):
            for g in grid:
                if least <= g < now[r]:
                    now[r] = g
                    out.append(tuple(now))
    return tuple(out)


SEQUENCE = joint_cutoffs()
#: Strata up to which their cutoffs are broadcast.
FEW = 50_000
_POS_BITS = 30


def _neighbours(items: Column, same) -> Column:
    """Items of a sorted array that are the same as one of their neighbours."""
    return let(items, lambda s: F.filter(s, lambda x, i: ((i > 0) & same(F.get(s, i - 1), x)) | F.coalesce(same(F.get(s, i + 1), x), F.lit(False))))


def _repeated_words(ws: Column) -> Column:
    """Number of positions inside a 3-word window that occurs twice or more.

    Candidates come from sorted longs that hold 34 bits of a hash and 30 bits of a position; they
    are confirmed on the words themselves, so hash collisions don't count.
    """
    low = (1 << _POS_BITS) - 1
    starts = F.sequence(F.lit(0), F.size(ws) - 3)
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)), _POS_BITS).bitwiseOR(i.cast("long")))
    maybe = _neighbours(F.sort_array(packed), lambda a, b: F.shiftright(a, _POS_BITS) == F.shiftright(b, _POS_BITS))
    where = F.transform(maybe, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    full = F.sort_array(F.transform(where, lambda p: F.struct(F.struct(F.get(ws, p).alias("a"), F.get(ws, p + 1).alias("b"), F.get(ws, p + 2).alias("c")).alias("w"), p.alias("p"))))
    sure = F.sort_array(F.transform(_neighbours(full, lambda a, b: a["w"] == b["w"]), lambda x: x["p"]))
    covered = let(sure, lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(covered).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base columns of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")

    def gone(chars: str) -> Column:
        return F.length(F.regexp_replace(text, chars, ""))

    out = docs.select(
        "doc_id", "lang",
        let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeated_words(ws).alias("n_repeat_words"))).alias("w"),
        gone(r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        (F.length(text) - gone("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "repeats": F.col("n_repeat_words") / n, "lines": F.col("n_dup_lines") / n}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in log space; exact up to rounding."""
    step = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    terms = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("last"), F.exp(first).alias("sum")),
        lambda a, i: let(a["last"] + F.log((n - i + 1).cast("double") / i) + step, lambda t: F.struct(t.alias("last"), (a["sum"] + F.exp(t)).alias("sum"))),
    )
    return F.when(k >= n, F.lit(1.0)).otherwise(terms["sum"])


def _rejects(steps) -> list[Column]:
    """Whether any rule rejects, for each joint cutoff."""
    r = _ratios()
    return [reduce(or_, [r[n] * 1000 > c for n, c in zip(RULES, step, strict=True)]) for step in steps]


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, sequence=SEQUENCE) -> DataFrame:
    """lang, pool, n, step (place in sequence, -1 if nothing is safe): a row for each stratum with labels enough, and one (pool is true) for the others.

    Counting is one aggregation over labelled rows, pre-aggregated before the shuffle; what is tested is
    strata x sequence rows.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    hold = rows.filter("not base_failed").join(good, "doc_id")
    ks = [f"k{i}" for i in range(len(sequence))]
    counts = hold.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(k) for k, x in zip(ks, _rejects(sequence), strict=True)])
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) + 1
    least = F.log(F.lit(delta) / tests) / math.log(1 - alpha)
    counts = counts.withColumns({"level": F.lit(delta) / tests, "pool": F.col("n") < least})
    strata = counts.groupBy("pool", F.when(~F.col("pool"), F.col("lang")).alias("lang"), "level").agg(*[F.sum(c).alias(c) for c in ("n", *ks)])
    long = strata.select("lang", "pool", "n", "level", F.posexplode(F.array(*ks)).alias("step", "k"))
    # k at or above the expected number can't pass; the sum is only formed below it
    safe = F.when(F.col("k") < F.col("n") * alpha, binomial_cdf(F.col("k"), F.col("n"), alpha) <= F.col("level")).otherwise(False)
    return long.groupBy("lang", "pool", "n").agg(F.max(F.when(safe, F.col("step")).otherwise(-1)).alias("step"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, sequence=SEQUENCE) -> DataFrame:
    """Base columns, the cutoffs in thousandths (null: none) and kept for every row of docs."""
    rows = cut(features(docs))
    name = lambda: F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))
    found = cut(cutoffs(rows, labels, alpha, delta, sequence))
    pool = found.filter("pool").first()
    own = found.filter("not pool").select(name().alias("stratum"), F.col("step").alias("own"))
    own = F.broadcast(own) if own.count() <= FEW else own
    at = F.coalesce("own", F.lit(pool.step if pool else -1))
    step = F.when(at >= 0, F.get(F.array(*[F.array(*map(F.lit, x)) for x in sequence]), at))
    out = rows.withColumn("stratum", name()).join(own, "stratum", "left").withColumn("cuts", step)
    r = _ratios()
    bad = reduce(or_, [F.coalesce(r[n] * 1000 > F.col("cuts")[i], F.lit(False)) for i, n in enumerate(RULES)])
    return out.select(*rows.columns, *[F.when(F.col("cuts")[i] < OFF, F.col("cuts")[i]).alias(f"cut_{n}") for i, n in enumerate(RULES)], (~F.col("base_failed") & ~bad).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
