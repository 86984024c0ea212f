"""Cleaning pipeline over documents: each stage is one operator of keyloom.llm, written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Language labels are decided by the first stage, and what is null, empty or repeated is treated as each
operator's docstring says.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from keyloom.llm.common import give_back, shared_folder

#: Documents whose best language is less probable are rejected.
MIN_LANGUAGE_SCORE = 0.3


def _stage(f):
    """f, beginning with the memory that earlier stages don't need any more returned by the executors."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language the network can't tell."""
    found = language_id.identify(docs, names=("__lang_pred", "__lang_score"))
    return found.filter((F.col("__lang_pred") != language_id.UND) & (F.col("__lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays."""
    return line_dedup.dedup_lines(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of similar texts."""
    return jaccard_join.one_of_each(docs)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_leaks), ("mixing sources", mix)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages before it wrote is removed once it is written; its own files are the result."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    for k in range(len(STAGES) - 1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{k}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
