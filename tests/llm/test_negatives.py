"""Hard negatives against brute force and SQL."""

import math
import random

import numpy as np

from tessella.llm import negatives, queries
from tests.llm.conftest import same_as_sql

ROWS = "vec_id long, label int, embedding array<float>, a long, score string, block int"


def brute(rows):
    """Rows (vec_id, label, vector) → the query's rows."""
    used = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for i, label, x in used:
        if i % 100:
            continue
        ranked = sorted(((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in used if j != i), key=lambda r: r[:2])
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [r for r in ranked if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:5]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROWS)
    moved = df.withColumn("label", negatives.moved_label(df.vec_id, df.label))
    found = negatives.hard_negatives(moved, moved.vec_id % 100 == 0)
    return sorted(tuple(r) for r in found.collect())


def made(n, seed, dims=8, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(10), [rng.gauss(0, spread) + 0.5 for _ in range(dims)]) for i in range(n)]


def test_against_brute_force(spark):
    rows = made(500, 1)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_ties_odd_rows_and_negative_ids(spark):
    rows = [(i, i % 3, [float(i % 4 - 1), 1.0]) for i in range(-200, 400)]
    rows += [(400, None, [1.0, 1.0]), (500, 1, None), (600, 2, [math.nan, 1.0]), (700, 2, [1.0, None]), (800, 2, [math.inf, 0.0]), (None, 1, [1.0, 1.0]), (900, 1, []), (1000, 1, [1.0])]
    assert mined(spark, rows) == brute(rows)


def test_several_blocks_give_the_same(spark, monkeypatch):
    rows = made(300, 2)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1024)
    monkeypatch.setattr(negatives, "SCORES", 64)
    assert mined(spark, rows) == brute(rows)


def test_one_label_for_all_and_empty_tables(spark):
    assert mined(spark, [(i, 1, [1.0, 2.0]) for i in range(1, 200) if i % 7]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []


def test_scores_are_exact_and_stop_at_the_ends_of_a_long():
    a, b = np.array([[3, -4]]), np.array([[1 << 30, 1], [-(1 << 61), 1 << 61]])
    assert negatives.scores(a, b[:1]).tolist() == [[3 * (1 << 30) - 4]]
    assert negatives.scores(np.array([[1 << 31, 1]]), np.array([[(1 << 25) + 1, 3]])).tolist() == [[(1 << 56) + (1 << 31) + 3]]
    assert negatives.scores(a, b[1:]).tolist() == [[-((1 << 63) - 1)]]


def test_huge_components(spark):
    rows = [(i, i % 2, [3e38, float(i)]) for i in range(0, 202)]
    assert {r[0] for r in mined(spark, rows)} == {0, 100, 200}


def test_query_equals_its_sql(spark, sf):
    same_as_sql(spark, sf, "op11_negatives")


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.op11_negatives(spark, sf).collect()) == brute(rows)
