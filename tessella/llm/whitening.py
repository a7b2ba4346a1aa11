"""Whitening of embeddings by hierarchical SVD merging.

Components of a vector are taken as whole numbers, floor(256 * c). The model is fitted on
distinct vectors: each task keeps (count, mean, singular values, right vectors) of what it has
read, batch by batch; two such summaries merge by one more SVD of both sets of scaled vectors
and a row for the difference of their means, which loses nothing, as all dimensions are kept.
Tasks' summaries merge in groups of ``FAN_IN``, level by level, until one is left. Nothing is
multiplied before it is centred.

Rows: a null vector, or one with a null or non-finite entry, is dropped; repeated rows give
rows of their own but count once in the fit; a null vec_id is passed on. Shorter vectors count
as padded with zeros. Entries beyond a long are its ends. A component without variance (fewer
distinct vectors than dimensions) has whitened values 0 and so an identity error of 1; a
``deviation`` that no long holds is null. No vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

SCALE = 256
COMPONENTS = 4
FAN_IN = 16
#: Rows whose SVD is taken at once.
ROWS = 4096
#: Variance, as a share of the mean square of a vector, up to which a component has none.
NOTHING = 1e-26

_LONG = 1 << 63
_SUMMARY = "part long, n long, sums array<decimal(38,0)>, mean array<double>, basis array<double>"

Summary = tuple[int, np.ndarray, np.ndarray]  # count, mean, singular values times right vectors


def finite(vector: Column) -> Column:
    """True where there is a vector and no entry of it is null, NaN or infinite."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def whole(vector: Column) -> Column:
    """floor(256 * c) of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """int64 rows of a list column, padded with zeros to ``width``."""
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def summary(rows: np.ndarray) -> Summary:
    mean = rows.mean(axis=0)
    _, s, vt = np.linalg.svd(rows - mean, full_matrices=False)
    return len(rows), mean, s[:, None] * vt


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of both lists of rows together."""
    (n, p, x), (m, q, y) = a, b
    bridge = np.sqrt(n * m / (n + m)) * (q - p)
    _, s, vt = np.linalg.svd(np.vstack([x, y, bridge]), full_matrices=False)
    return n + m, p + (q - p) * (m / (n + m)), s[:, None] * vt


def _row(part: int, sums: list[int], made: Summary) -> pa.RecordBatch:
    n, mean, basis = made
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0))),
            pa.array([mean], pa.list_(pa.float64())), pa.array([basis.ravel()], pa.list_(pa.float64())),
        ],
        names=["part", "n", "sums", "mean", "basis"],
    )


def _summaries(width: int):
    """Over rows (part, x), one part a task: its summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, part = None, [0] * width, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                part, rows = some.column(0)[0].as_py(), matrix(some.column(1), width)
                sums = [a + b for a, b in zip(sums, exact_sums(rows))]
                made = summary(rows.astype(np.float64))
                held = made if held is None else merged(held, made)
        if held is not None:
            yield _row(part, [Decimal(x) for x in sums], held)

    return run


def exact_sums(rows: np.ndarray) -> list[int]:
    """Column sums, in Python integers where longs might not hold them."""
    if len(rows) and np.abs(rows.astype(np.float64)).max(initial=0) * len(rows) >= _LONG / 2:
        return [int(x) for x in rows.astype(object).sum(axis=0)]
    return [int(x) for x in rows.sum(axis=0)]


def _of(row: dict, width: int) -> Summary:
    return row["n"], np.array(row["mean"]), np.array(row["basis"]).reshape(-1, width)


def _merge(width: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        held = _of(rows[0], width)
        for r in rows[1:]:
            held = merged(held, _of(r, width))
        return pa.Table.from_batches([_row(rows[0]["part"] // FAN_IN, [Decimal(sum(map(int, x))) for x in zip(*(r["sums"] for r in rows))], held)])

    return run


def fitted(vectors: DataFrame, width: int) -> tuple[list[int], Summary] | None:
    """``vectors`` (x array<long>) → their exact sums and the one summary of all; None for no rows."""
    level = materialise(vectors.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(_summaries(width), _SUMMARY))
    while level.count() > 1:
        groups = level.groupBy(F.floor(F.col("part") / FAN_IN).alias("g"))
        level = materialise(groups.applyInArrow(_merge(width), _SUMMARY))
    top = level.first()
    return None if top is None else ([int(x) for x in top.sums], _of(top.asDict(), width))


def components(made: Summary, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance, unit eigenvectors (rows) and the trace, by falling eigenvalue."""
    n, _, basis = made
    _, s, vt = np.linalg.svd(basis, full_matrices=False)
    count = min(count, basis.shape[1])
    values, vectors = np.zeros(count), np.zeros((count, basis.shape[1]))
    k = min(count, len(s))
    values[:k], vectors[:k] = s[:k] ** 2 / n, vt[:k]
    return values, vectors, float((s**2).sum() / n)


def _projected(sums: list[int], n: int, values: np.ndarray, vectors: np.ndarray, trace: float):
    """int64 rows → their whitened coordinates."""
    mean = np.array([x / n for x in sums])
    live = values > NOTHING * (trace + float(mean @ mean))
    scaled = np.where(live[:, None], vectors / np.sqrt(np.where(live, values, 1))[:, None], 0)
    return lambda rows: (rows - mean) @ scaled.T


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2."""
    far = n * max((abs(int(x)) for x in (rows.min(initial=0), rows.max(initial=0))), default=0) + max(map(abs, sums), default=0)
    if far * far * rows.shape[1] < _LONG:
        return ((n * rows - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((rows.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(x) if x < _LONG else None for x in exact]


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of
    ``embeddings`` (vec_id, embedding, ...) that is not dropped, for the first ``count`` components."""
    spark = embeddings.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(finite(F.col("v"))).select("vec_id", whole(F.col("v")).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], out)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = materialise(rows.select(padded.alias("x")).distinct())
    sums, made = fitted(fit, width)
    n = made[0]
    values, vectors, trace = components(made, count)
    place = _projected(sums, n, values, vectors, trace)
    error = _identity_error(fit, width, place, len(values))
    shares = [float(v / trace) if trace else 0.0 for v in values]
    k = len(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = matrix(some.column(1), width)
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                made = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                    pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(place(x).ravel()),
                    pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in out.split(", ")])

    return rows.mapInArrow(score, out)


def _identity_error(fit: DataFrame, width: int, place, count: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by the
    same merging over the whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                part, made = some.column(0)[0].as_py(), summary(place(matrix(some.column(1), width)))
                held = made if held is None else merged(held, made)
        if held is not None:
            yield _row(part, [], held)

    level = materialise(fit.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(run, _SUMMARY))
    while level.count() > 1:
        level = materialise(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInArrow(_merge(count), _SUMMARY))
    n, _, basis = _of(level.first().asDict(), count)
    return float(np.abs(basis.T @ basis / n - np.eye(count)).max())
