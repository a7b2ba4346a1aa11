"""Single-pass counters over a stream: counts by key, kept as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_counts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(kind, key, n): each row is counted once under each of ``keys``."""
    pairs = [F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias("key")) for k in keys]
    return rows.select(F.explode(F.array(*pairs)).alias("g")).groupBy("g.kind", "g.key").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, length: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """Tumbling event-time counts with a bound on lateness."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def drain(query_rows: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Run a streaming query over all that is there, into the memory table ``name``: for
    counts by a bounded number of keys, as the table is held by the driver."""
    writer = query_rows.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def drain_to(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming query over all that is there and not yet done, appending Parquet files.
    A later run with the same checkpoint goes on where this one ended."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()
