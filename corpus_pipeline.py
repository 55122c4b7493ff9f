"""Training-data pipeline: five stages over documents, each one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dunlake.llm.classifier import keep_quality
from dunlake.llm.common import stored, table
from dunlake.llm.lines import clean_lines
from dunlake.llm.packing import pack
from dunlake.llm.queries import vocabulary
from dunlake.llm.setjoin import one_per_group
from dunlake.llm.substrings import clean_spans


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of later repeated runs; those that lose every line go."""
    return clean_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar ones, with each of its different texts."""
    return one_per_group(docs, every_text=True)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes of strings that start earlier too; those that lose every word go."""
    return clean_spans(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the hashed models nor the tokens; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
