"""Ranks, samples and draws by hash: the same rows whatever the partitioning.

An exact global rank needs no single-task window: a 48-bit hash orders rows, its leading
bits name one of the buckets in that order, a bucket's rows are ranked in their own task,
and the buckets' offsets are a small table. Buckets are as many as rows ask for, a power of
two, so a bucket holds about ``BUCKET_ROWS`` rows whatever the input. The smallest so many
rows need no rank of the others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import SPAN, uniform

BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 1 << 20


def hash_rank(df: DataFrame, order: Column, tie: str, within: list[str] | None = None, name: str = "rank", total: str = "total") -> DataFrame:
    """Adds the 1-based rank by (``order``, ``tie``) and the count of rows, per ``within``
    group or overall. ``order`` is a BIGINT in [0, 2^48), evenly spread."""
    keys = within or []
    buckets = min(1 << max(0, (df.count() // BUCKET_ROWS)).bit_length(), MOST_BUCKETS)
    marked = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", (SPAN // buckets).bit_length() - 1).cast("int"))
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    per_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = counts.select(
        *keys,
        "_b",
        (F.sum("_n").over(per_group.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(per_group).alias(total),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", tie))
    held = offsets if keys else F.broadcast(offsets)
    ranked = marked.withColumn("_r", inside).join(held, [*keys, "_b"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_o", "_b", "_r", "_before")


def bottom_k(df: DataFrame, order: Column, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of smallest hash: a simple random sample without replacement, and as
    mergeable as a reservoir."""
    if k <= 0:
        return df.limit(0)
    return df.orderBy(order, tie).limit(k)


def half_even(share: float, count: Column) -> Column:
    """round(count * share), halves to even."""
    return F.bround(count.cast("double") * F.lit(float(share)), 0).cast("bigint")


def stratified(df: DataFrame, order: Column, tie: str, stratum: str, fraction: float) -> DataFrame:
    """Of each stratum of more than one row, max(1, round(n * fraction)) rows but never all."""
    if fraction <= 0:
        return df.limit(0)
    ranked = hash_rank(df, order, tie, [stratum], "_rank", "_total")
    wanted = F.least(F.greatest(half_even(fraction, F.col("_total")), F.lit(1)), F.col("_total") - 1)
    return ranked.filter((F.col("_total") > 1) & (F.col("_rank") <= wanted)).drop("_rank", "_total")


def weighted_choice(draw: Column, weights: Mapping[str, float]) -> Column:
    """The first name whose cumulative weight reaches draw * total; the last one otherwise."""
    total, reached, out = sum(weights.values()), 0.0, None
    for name, weight in weights.items():
        reached += weight
        hit = F.lit(reached) >= draw * F.lit(total)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(next(reversed(weights)))


def bernoulli(p: float, *key: Column | object) -> Column:
    return uniform(*key) < F.lit(float(p))
