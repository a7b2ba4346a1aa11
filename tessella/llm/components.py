"""Connected components by alternating large-star and small-star steps.

Links stay distributed: each round is two keyed minima (combined before the
shuffle) and two equi-joins whose skewed keys Spark may split, and is checkpointed,
so neither a hub vertex nor a long chain meets in one task or in the driver. Rounds grow with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written out, so that the join below shuffles both sides for itself and a hub's
    # links can be split over tasks
    least = materialise(_least(both).select("u", F.least("u", "least").alias("least")))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return (
        moved.unionByName(least.select("u", F.col("least").alias("v")))
        .filter("u <> v")
        .distinct()
    )


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``links`` (u, v) of one orderable type → (u, root) for every vertex that is not
    its component's smallest. Vertices without links do not appear. Self-links and
    nulls are ignored. Raises if ``max_rounds`` do not settle."""
    edges = materialise(
        links.select("u", "v")
        .filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        edges = materialise(_small_star(_large_star(edges)))
        # settled when every vertex has one link and no root has any of its own
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
