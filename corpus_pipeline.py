"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again as the next one's docs. All but the last return the
columns of documents. The stages cope with null and empty texts, repeated rows and empty tables as their operators
say; a document that holds a benchmark passage goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import decontaminate, exact_dedup, mixing, near_dedup, ngrams, quality
from quillforge.llm.keep import keep_rows
from quillforge.llm.scratch import written

#: near copies of a stage: pairs at a similarity of 0.80 or more (op10 keeps its contract of 0.85)
NEAR_LEAST = 80
#: words of a run of the quality stage, half of what op1 takes: all stages share an executor's memory, and the pipeline may use more disk
GATHER = ngrams.GATHER // 2

#: a language model and a mixing rule that iterates are beyond SQL
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_rows(docs, quality.classify(docs, labels, gather=GATHER))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, exact_dedup.decisions(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the least id."""
    return keep_rows(docs, near_dedup.near_duplicates(docs, least=NEAR_LEAST))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keep_rows(docs, found.select("id", "tx", (F.size("spans") == 0).alias("kept")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the copy's number, from 1, in mix_copy (which replaces a column of that name).

    Rows that repeat an id, a text and a source share their copies, as many as the mix takes of them.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
