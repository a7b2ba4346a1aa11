"""Training logs as tables: losses, throughput, profiler windows and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import permute


def perplexity(loss: Column) -> Column:
    """exp of the loss, capped at 20; NaN stays NaN."""
    return F.when(F.isnan(loss), F.lit(float("nan"))).otherwise(F.exp(F.least(loss, F.lit(20.0))))


def valid_tokens(labels: Column) -> Column:
    """Labels that count for a causal loss: all but the first that are not -100."""
    later = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.size(F.filter(later, lambda x: x != -100))


def weighted_loss(batches: DataFrame, loss: str = "loss", tokens: str = "n_tokens") -> DataFrame:
    """One row: loss weighted by tokens, and its perplexity."""
    total = F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.coalesce(F.sum(tokens), F.lit(0)), F.lit(1))
    out = batches.agg(F.coalesce(total, F.lit(0.0)).alias("loss"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("n_tokens"))
    return out.withColumn("perplexity", perplexity(F.col("loss")))


def log_windows(steps: DataFrame, every: int) -> DataFrame:
    """(window, steps, loss_mean): running mean of the loss per ``every`` steps (from 1)."""
    bucket = F.ceil(F.col("step") / every).cast("bigint")
    return steps.groupBy(bucket.alias("window")).agg(F.count("*").alias("steps"), F.avg("loss").alias("loss_mean"))


def throughput(marks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From cumulative (t seconds, tokens, samples): rates since the mark before, over at
    least a microsecond; a group's first mark has none."""
    order = Window.partitionBy(*by or [F.lit(0)]).orderBy("t")
    elapsed = F.greatest(F.col("t") - F.lag("t").over(order), F.lit(1e-6))
    rate = lambda c: (F.col(c) - F.lag(c).over(order)) / elapsed
    return marks.withColumn("tokens_per_sec", rate("tokens")).withColumn("samples_per_sec", rate("samples"))


PHASES = ("data_time_sec", "fwd_bwd_time_sec", "optimizer_time_sec", "step_time_sec")


def profiler_averages(steps: DataFrame, by: list[str]) -> DataFrame:
    """Means of the four phases and two ratios to the step, by group."""
    means = steps.groupBy(*by).agg(F.count("*").alias("count"), *[F.avg(p).alias(p) for p in PHASES])
    step = F.greatest(F.col("step_time_sec"), F.lit(1e-9))
    return means.withColumn("data_time_ratio", F.col("data_time_sec") / step).withColumn("optimizer_time_ratio", F.col("optimizer_time_sec") / step)


def global_batches(blocks: DataFrame, step: str) -> DataFrame:
    """(step, samples, tokens) over all ranks."""
    return blocks.groupBy(step).agg(F.count("*").alias("samples"), F.sum(F.size("input_ids")).cast("bigint").alias("tokens"))


def batched(rows: DataFrame, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds ``batch`` to rows that carry a dense 0-based ``order``."""
    marked = rows.withColumn("batch", F.floor(F.col(order) / size))
    if not drop_last:
        return marked
    whole = marked.groupBy("batch").count().filter(F.col("count") == size).select("batch")
    return marked.join(whole, "batch", "left_semi")


def epoch_batches(rows: DataFrame, number: str, total: int, size: int, seed: int, epoch: int = 0, skip: int = 0, drop_last: bool = True) -> DataFrame:
    """``rows``, which carry a dense 0-based ``number`` below ``total``, with their ``place`` in the
    shuffled epoch and their ``batch``, from batch ``skip`` on. The place is a keyed permutation
    of the number, so nothing is sorted or counted, and resuming reads no batch that is done."""
    placed = rows.withColumn("place", permute.permuted(F.col(number), total, seed, "epoch", epoch))
    end = total - total % size if drop_last else total
    kept = placed.filter((F.col("place") >= skip * size) & (F.col("place") < end))
    return kept.withColumn("batch", F.call_function("div", F.col("place"), F.lit(size)))


def batch_numbers(spark: SparkSession, batch: int, size: int, total: int, seed: int, epoch: int = 0) -> DataFrame:
    """(place, number) of one batch, found from its places alone."""
    places = spark.range(batch * size, min(total, (batch + 1) * size)).withColumnRenamed("id", "place")
    return places.withColumn("number", permute.unpermuted(F.col("place"), total, seed, "epoch", epoch))


# -- checkpoints ----------------------------------------------------------------------


def step_name(step: Column) -> Column:
    return F.format_string("step-%07d", step)


def latest_checkpoint(names: DataFrame, by: list[str]) -> DataFrame:
    """The greatest step name of each run: names are padded, so text order is step order."""
    return names.groupBy(*by).agg(F.max("name").alias("name"))


def expired(names: DataFrame, by: list[str], keep: int) -> DataFrame:
    """Checkpoints beyond the last ``keep`` of each run; keep <= 0 keeps all."""
    if keep <= 0:
        return names.limit(0)
    order = Window.partitionBy(*by).orderBy(F.col("name").desc())
    return names.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") > keep).drop("_r")


def checkpoint_status(runs: DataFrame) -> DataFrame:
    """Adds ``status`` from resume_dir, files_present, expected_hash, actual_hash, global_step,
    max_train_steps, completed and weights_present."""
    done = F.coalesce(F.col("completed"), F.lit(False)) | F.coalesce(F.col("global_step") >= F.col("max_train_steps"), F.lit(False))
    status = (
        F.when(F.col("resume_dir").isNull() | ~F.col("files_present"), "missing")
        .when(F.col("expected_hash") != F.col("actual_hash"), "mismatch")
        .when(done & F.col("weights_present"), "complete")
        .otherwise("resumable")
    )
    return runs.withColumn("status", status)
