"""The corpus pipeline: documents to packed bins, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, pack, quality, simhash
from tessella.llm.common import scratch_dir, table
from tessella.sources import files


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    return simhash.keep_documents(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its bin; sizes are tokens, and what is
    alike by SimHash, though not a near copy, is kept apart."""
    return pack.pack(pack.sized_by_tokens(docs))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", free_of_benchmarks),
    ("packing", packed),
]

#: The classifier's posterior and the bins' order of placement are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again, and a
    stage's folder goes when the next one is written."""
    root = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            files.delete(spark, f"{root}/{before}")
        before = name
    return docs
