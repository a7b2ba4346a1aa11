"""Question rows as they are loaded for training: checked in the pass that reads them.

Rows that break a rule go to a quarantine folder with the rule's name; those that keep all of
them stand beside it. Both are written by one job, which counts them as it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.operators import evaluation
from tessella.sources import tables

#: Columns that question files must have; metadata names the kind of question and the row's split.
SCHEMA = "messages array<struct<role string, content string>>, metadata struct<qa_type string, split string>"
CORRUPT = "corrupt"
NO_OBJECT = "not a JSON object"


def load_questions(spark: SparkSession, sources: dict[str, list[str]], at: str, more: str = "") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept, refused, counts) of the files of each split, checked as questions of that split and
    written below ``at``; ``more`` are further columns of the files. Refused rows carry
    ``violation``. Without a kept train row there is nothing to train on, which is an error."""
    schema = SCHEMA + (f", {more}" if more else "")
    read = tables.concatenated(spark, sources, schema, CORRUPT)
    rows = read.withColumns({"qa_type": F.col("metadata.qa_type"), "row_split": F.col("metadata.split")})
    checked = evaluation.sft_violations(rows, F.col("split"))
    named = checked.withColumn("violation", F.when(F.col(CORRUPT).isNotNull(), NO_OBJECT).otherwise(F.col("violation")))
    seen = Observation()
    wrong = F.col("violation").isNotNull()
    counted = named.observe(seen, F.count_if(~wrong).alias("kept"), F.count_if(wrong).alias("refused"), F.count_if(~wrong & (F.col("split") == "train")).alias("train"))
    counted.drop("qa_type", "row_split").withColumn("state", F.when(wrong, "refused").otherwise("kept")).write.partitionBy("state").parquet(at)
    counts = {k: int(v) for k, v in seen.get.items()}
    if not counts["train"]:
        raise ValueError(f"no row of the train split is valid; see {at}")
    back = spark.read.parquet(at)
    return back.filter("state = 'kept'").drop("state", "violation", CORRUPT), back.filter("state = 'refused'").drop("state"), counts
