"""Whitening against a direct eigendecomposition."""

import math

import numpy as np
import pytest

from tessella.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>, x string, part long, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], ROWS)


def expected(rows):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} from exact sums and eigh."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in good)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        own = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        for k in range(min(4, width)):
            e = values[-1 - k]
            out[i, k + 1] = n, deviation, abs(own @ vectors[:, -1 - k]) / math.sqrt(e), e / values.sum()
    return out


def compared(got, want):
    assert len(got) == len(want) == len({(r.vec_id, r.component) for r in got})
    for r in got:
        n, deviation, size, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(size, rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(share, rel=1e-9)
        assert 0 <= r.identity_error <= 1e-9


@pytest.mark.parametrize("step", [4096, 7])
def test_against_a_direct_decomposition(spark, step, monkeypatch):
    """Repeated, odd and shifted rows; also where summaries are merged after every few rows."""
    monkeypatch.setattr(whitening, "ROWS", step)
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (300, 7)) @ np.diag([5, 3, 2, 1.5, 1, 0.5, 0.1]) + 40
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third is one vector
    rows += [(2000, None), (2001, [1.0, None] * 3 + [1.0]), (2002, [math.nan] * 7), (2003, [math.inf] + [0.0] * 6), (2004, [-0.0] * 7), (2005, [1.0, 2.0])]
    compared(whitening.whiten(frame(spark, rows)).collect(), expected(rows))


def test_query_over_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_whitening(spark, sf).collect()
    compared(got, expected(rows))
    signs = {(r.vec_id, r.component): r.whitened for r in got}
    table = np.array([[signs[i, k] for k in (1, 2, 3, 4)] for i, _ in rows])
    assert np.abs(table.T @ table / len(rows) - np.eye(4)).max() < 1e-9  # one sign for all rows


def test_merging_is_lossless():
    rng = np.random.default_rng(5)
    x = rng.normal(100, 3, (500, 12))
    held = whitening.summary(x[:3])  # fewer rows than dimensions
    for at in (3, 4, 90, 300):
        to = {3: 4, 4: 90, 90: 300, 300: 500}[at]
        held = whitening.merged(held, whitening.summary(x[at:to]))
    n, mean, basis = held
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-13)
    assert np.allclose(basis.T @ basis, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-9, atol=1e-8)


def test_without_variance_and_without_rows(spark):
    one = whitening.whiten(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0]), (None, [2.0, 3.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 1.0)] * 6
    assert sorted(r.component for r in one) == [1, 1, 1, 2, 2, 2]
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_huge_components(spark):
    got = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 2.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)


def test_deviations_that_longs_hold_are_exact():
    rows, sums = np.array([[1 << 20, 3], [5, -7]]), [(1 << 20) + 5, -4]
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(x, sums)) for x in rows]
    assert whitening.deviations(rows, 2, sums) == want
    assert whitening.deviations(rows << 30, 2, [s << 30 for s in sums])[0] is None
