"""Mixing sources to target weights by hash-threshold histograms (operator 3, DataFrame functions only).

Every document has a 60-bit hash of its id and text, and one of its row. A source that needs a fraction of an
epoch takes the documents below a threshold of (hash, row hash). The threshold comes from nested histograms:
words by (source, top 12 bits); the boundary bucket alone is histogrammed again by the next 12 bits, and so
on down both hashes; what is left at last is walked by the last bits. The row hash matters only where copies of
one row stand at the boundary: they are equal, so which of them is taken makes no difference, but how many does.

Nothing is sorted but bucket rows. Documents meet the plan of their source in a broadcast join, if there are few
sources, else in a join whose keys are salted; the final filter is a comparison per document. So a source with a third of
all rows isn't dealt to one task.

Defined results: null or blank text has size 0 and takes 0 words; null source is a source of its
own, ordered last; null doc_id hashes as the empty text; of repeated rows as many are taken as the target
needs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, table, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Bits of a histogram; bits of a hash.
BITS, HASH = 12, 60
#: Sources, and characters of their names, up to which a table of one row a source is broadcast; else each source's key is salted.
FEW, FEW_CHARS, SALTS = 50_000, 4 << 20, 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows -> one row per source with its target words.

    Targets are proportional to the cycled weights; those above max_epochs x their source's size stop
    there and the rest is shared again. That fixed point is target = min(cap, level x weight), whose level
    is found by one pass over the sources in order of cap / weight. The one-partition windows run over
    one row per source, after aggregation.
    """
    one = F.lit(0)
    by_name = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    fill = Window.partitionBy(one).orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(one)
    slot = (F.row_number().over(by_name) - 1) % len(weights)
    s = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), slot + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("try", F.col("rest").cast("double") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "try"))).over(everything)["try"])
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def _cross(hist: DataFrame) -> DataFrame:
    """key, p, left, s, n: the first bucket p of each source whose running total exceeds what is left of the budget, and what is left at its start."""
    upto = F.sum("s").over(Window.partitionBy("key").orderBy("b"))
    over = hist.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
    first = over.groupBy("key").agg(F.min(F.struct("b", (F.col("left") - F.col("upto") + F.col("s")).alias("left"), "s", "n")).alias("x"))
    return first.select("key", F.col("x.b").alias("p"), "x.left", "x.s", "x.n")


def _boundary(rows: DataFrame, edge: DataFrame, of: str, meet) -> DataFrame:
    """_cross() for buckets that are single hashes. edge: key, left; of: the hash's column. Each level's histogram covers the boundary bucket of the last."""
    on, above = ["key"], None
    for shift in (HASH - BITS, HASH - 2 * BITS, 0):
        level = rows if above is None else rows.withColumn("p", F.shiftright(of, above))
        level = level.select("size", "row", F.shiftright(of, shift).alias("b"), *on)
        hist = meet(level, edge.select("left", *on), on).groupBy("key", "b").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
        edge, on, above = cut(_cross(hist)), ["key", "p"], shift
    return edge


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, few: int = FEW) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs. few: sources up to which tables are broadcast."""
    name = lambda: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    n = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("row"))
    n = cut(n).withColumns({"u": F.shiftrightunsigned(F.xxhash64("row"), 64 - HASH), "key": name()})
    targets = source_targets(n.select("source", "size"), weights, max_epochs).withColumn("key", name()).drop("source")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    targets = cut(targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    sources, chars = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()

    def meet(rows: DataFrame, plan: DataFrame, on: list[str]) -> DataFrame:
        """rows joined with plan, a table of one row a source."""
        if sources <= few and chars <= FEW_CHARS:
            return rows.join(F.broadcast(plan), on)
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")

    # a budget that nothing exceeds has no boundary
    found = _boundary(n, targets.select("key", F.col("budget").alias("left")), "h", meet)
    # the document that crosses the budget is taken if that comes nearer to it
    nearer = F.col("s") - F.col("left") < F.col("left")
    plan = targets.join(found.select("key", F.col("p").alias("h_edge"), nearer.alias("h_taken")), "key", "left")
    tied = found.filter("n > 1").select("key", "p", "left")
    inside = F.col("h_taken")
    if not tied.isEmpty():
        rows = meet(n.select("key", "size", "row", "u", F.col("h").alias("p")), tied.select("key", "p"), ["key", "p"]).drop("p")
        copies = _boundary(cut(rows), tied.select("key", "left"), "u", meet)
        plan = plan.join(copies.select("key", F.col("p").alias("u_edge"), nearer.alias("u_taken")), "key", "left")
        inside = F.when(F.col("u_edge").isNull(), F.col("h_taken")).otherwise((F.col("u") < F.col("u_edge")) | ((F.col("u") == F.col("u_edge")) & F.col("u_taken")))
    extra = (F.col("budget") > 0) & (F.col("h_edge").isNull() | (F.col("h") < F.col("h_edge")) | ((F.col("h") == F.col("h_edge")) & inside))
    out = meet(n, cut(plan), ["key"]).withColumn("copies", (F.col("epochs") + F.when(extra, 1).otherwise(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h, row_number() OVER () AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
t AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS DOUBLE) AS attempt
      FROM r WINDOW q AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(attempt, ratio) AS level FROM t WHERE attempt <= ratio),
g AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target FROM t, l),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM g),
c AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND (upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
