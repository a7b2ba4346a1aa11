"""The keyed permutation, epochs that resume, and recipes that are unranked."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import permute
from tessella.operators import trainlog, world


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000])
def test_every_place_is_taken_once_and_leads_back(spark, n):
    rows = spark.range(n).withColumn("p", permute.permuted(F.col("id"), n, 7, "x")).withColumn("b", permute.unpermuted(F.col("p"), n, 7, "x")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.b == r.id for r in rows)
    if n >= 17:
        other = [r.p for r in spark.range(n).select(permute.permuted(F.col("id"), n, 8, "x").alias("p")).collect()]
        assert other != [r.p for r in rows] != list(range(n))


@pytest.mark.parametrize("n", [10**9 + 7, (1 << 53) + 5, permute.MOST])
def test_large_spaces(spark, n):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, n // 2, n - 2, n - 1, n, -1, None)], "v long")
    got = rows.withColumn("p", permute.permuted(F.col("v"), n, 1)).withColumn("b", permute.unpermuted(F.col("p"), n, 1)).collect()
    inside = [r for r in got if r.v is not None and 0 <= r.v < n]
    assert len({r.p for r in inside}) == 6 and all(0 <= r.p < n and r.b == r.v for r in inside)
    assert all(r.p is None for r in got if r not in inside)


def test_places_are_spread(spark):
    """Neighbours do not stay neighbours, and no part of the range is favoured."""
    n = 4000
    places = [r.p for r in spark.range(n).orderBy("id").select(permute.permuted(F.col("id"), n, 3, "s").alias("p")).collect()]
    steps = [abs(a - b) for a, b in zip(places, places[1:])]
    assert abs(sum(steps) / len(steps) - n / 3) < n / 20
    assert abs(sum(p < n // 2 for p in places[: n // 2]) - n / 4) < 4 * math.sqrt(n / 16)
    with pytest.raises(ValueError):
        permute.bases(0)
    with pytest.raises(ValueError):
        permute.bases(permute.MOST + 1)


def test_a_resumed_epoch_is_the_tail_of_a_whole_one(spark):
    rows = spark.range(103).withColumnRenamed("id", "number")
    order = lambda df: [(r.place, r.number, r.batch) for r in df.orderBy("place").collect()]
    whole = order(trainlog.epoch_batches(rows, "number", 103, 10, 5))
    assert len(whole) == 100 and [p for p, _, _ in whole] == list(range(100))
    resumed = trainlog.epoch_batches(rows, "number", 103, 10, 5, skip=4)
    assert order(resumed) == whole[40:]
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert order(trainlog.epoch_batches(rows, "number", 103, 10, 5, epoch=1)) != whole
    assert len(order(trainlog.epoch_batches(rows, "number", 103, 10, 5, drop_last=False))) == 103
    one = {(r.place, r.number) for r in trainlog.batch_numbers(spark, 4, 10, 103, 5).collect()}
    assert one == {(p, i) for p, i, b in whole if b == 4}
    assert trainlog.batch_numbers(spark, 10, 10, 103, 5).count() == 3


def causes_of(spark, n):
    return spark.range(n).select(F.col("id").alias("cause_index"), world.formatted_id("C", F.col("id")).alias("cause_id"))


@pytest.mark.parametrize(("n", "arity", "replacement", "space"), [(5, 3, False, 60), (4, 4, False, 24), (4, 2, True, 16), (6, 1, False, 6)])
def test_all_recipes_are_drawn_once(spark, n, arity, replacement, space):
    effects = spark.range(space).withColumnRenamed("id", "relation_index")
    drawn = [tuple(r.recipe) for r in world.drawn_recipes(effects, causes_of(spark, n), arity, 3, replacement).collect()]
    assert len(set(drawn)) == space and {len(r) for r in drawn} == {arity}
    assert replacement or all(len(set(r)) == arity for r in drawn)
    with pytest.raises(RuntimeError):
        world.drawn_recipes(spark.range(space + 1).withColumnRenamed("id", "relation_index"), causes_of(spark, n), arity, 3, replacement)


def test_recipes_beyond_the_permutation_and_repeating_ones(spark):
    effects, causes = spark.range(200).withColumnRenamed("id", "relation_index"), causes_of(spark, 500)
    long = [tuple(r.recipe) for r in world.drawn_recipes(effects, causes, 9, 3).collect()]  # 500^9 is beyond a long
    assert len(set(long)) == 200 and all(len(set(r)) == 9 for r in long)
    free = [tuple(r.recipe) for r in world.drawn_recipes(spark.range(300).withColumnRenamed("id", "relation_index"), causes_of(spark, 4), 2, 3, unique=False).collect()]
    assert len(free) == 300 and len(set(free)) == 12 and all(len(set(r)) == 2 for r in free)
