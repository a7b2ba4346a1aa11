"""A sample of a stream, kept in one pass: the rows of smallest hash so far. Samples merge, so
a micro-batch is reduced by itself and joined to what is kept, a table of as many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tessella.operators.sampling import bottom_k
from tessella.sources import files


def stream_sample(rows: DataFrame, order: Column, tie: str, k: int, path: str, checkpoint: str) -> DataFrame:
    """Drain the stream ``rows`` and return the ``k`` rows of smallest ``order``, those of
    earlier runs with the same ``path`` and ``checkpoint`` included. Each batch writes a table
    of its own, from the one before, so a batch that is run again gives the same."""
    spark, schema = rows.sparkSession, rows.schema

    def kept(before: int | None = None) -> DataFrame | None:
        done = [n for n in files.names(spark, path) if n.startswith("batch-") and (before is None or n < f"batch-{before:012d}")]
        return spark.read.schema(schema).parquet(f"{path}/{done[-1]}") if done else None

    def merge(batch: DataFrame, number: int) -> None:
        held = kept(number)
        both = bottom_k(batch, order, tie, k)
        bottom_k(both if held is None else held.unionByName(both), order, tie, k).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = kept()
    return spark.createDataFrame([], schema) if found is None else found
