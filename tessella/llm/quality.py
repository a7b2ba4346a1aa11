"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives ``FEATURES`` numbers, counts and ratios under logarithms so that a
class is roughly normal in them. Class means and covariances come from sums that
Spark combines over every labelled training row; each covariance is shrunk towards
the diagonal of the pooled one, factored once (Cholesky) on the driver, and the
factors travel with the scoring function. The score is the posterior of label 1,
from the difference of the two Mahalanobis log densities.

Labels are learnt only from rows whose crc32(doc_id as text) mod ``FOLDS`` is not 0.
Label, language, source and id are no features. Of more than ``LABELS`` labels about so
many are learnt from, drawn by the hash of their id; the drawn ids are broadcast, so that
in a pipeline only their texts are read before the one pass that scores everything.

Rows: null text counts as empty and gets a score like any text; labels that are null
or neither 0 nor 1 are not learnt from; a document counts once for each different label
of its id; repeated rows keep a row each, and each is learnt from; a null doc_id
is never a training row and is not held out. With fewer than two rows of either class
every score is the share of label 1 among the labelled (one half without any).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import hash_below, materialise, materialise_texts

FOLDS = 5
SHRINKAGE = 0.3
CUT = 0.3
#: About how many labels are learnt from at most.
LABELS = 500_000

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _HIGH = b"0123456789", bytes(range(128, 256))
_SPACE, _MARK = b" \t\n\r\x0b\x0c", b".,;:?'\"-()"

FEATURES = (
    "words", "word_length", "odd_signs", "upper_case", "digits", "marks",
    "distinct_words", "same_as_next", "distinct_lines", "compressed", "full_stops", "short_words",
)


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of one text, in order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size, words, lines = len(raw), raw.split(), raw.split(b"\n")
    n = len(words)
    upper, lower, digit, high, space, mark = (size - len(raw.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT, _HIGH, _SPACE, _MARK))
    odd, log = size - upper - lower - digit - high - space - mark, math.log
    return [
        log(n + 1),
        log((size - space + 1) / (n + 1)),
        log(odd / (size + 1) + 0.005),
        log((upper + 0.5) / (upper + lower + high + 1) + 0.01),
        log(digit / (size + 1) + 0.005),
        log(mark / (size + 1) + 0.01),
        log((len(set(words)) + 1) / (n + 1)),
        log(sum(map(bytes.__eq__, words, words[1:])) / (n + 1) + 0.01),
        log(len(set(lines)) / len(lines)),
        log(len(zlib.compress(raw, 1)) / (size + 20)),
        log(raw.count(b".") / (n + 1) + 0.02),
        log(sum(map((4).__gt__, map(len, words))) / (n + 1) + 0.02),
    ]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return of(text)


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Log densities of two normal classes; ``factors`` are inverted Cholesky factors."""

    priors: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    log_dets: tuple[float, float] = (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.priors[1])
        density = [
            math.log(p) - 0.5 * (((x - mu) @ f.T) ** 2).sum(axis=1) - 0.5 * d
            for p, mu, f, d in zip(self.priors, self.means, self.factors, self.log_dets)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(training: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """``training`` (label int, x array<double>). Returns to the driver one row of sums
    for each class: the number of features squared, whatever the rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in training.filter("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    n = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    if min(n) < 2:
        share = n[1] / sum(n) if sum(n) else 0.5
        return Discriminant((1 - share, share))
    means, covs = [], []
    for k in (0, 1):
        mu = np.array([rows[k][f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = rows[k][f"p{i}_{j}"]
        means.append(mu)
        covs.append((second - n[k] * np.outer(mu, mu)) / (n[k] - 1))
    pooled = sum(c * (m - 1) for c, m in zip(covs, n)) / (sum(n) - 2)
    target = np.diag(np.maximum(np.diag(pooled), 1e-6))
    lower = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target) for c in covs]
    return Discriminant(
        tuple(m / sum(n) for m in n),
        tuple(means),
        tuple(np.linalg.inv(f) for f in lower),
        tuple(2 * np.log(np.diag(f)).sum() for f in lower),
    )


def _marks(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, label) of the training folds, at most about ``most``, by the hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    known = known.filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).distinct()
    return materialise(known.filter(hash_below(F.xxhash64("doc_id"), most, known.count())))


def _training(features: DataFrame, marks: DataFrame) -> DataFrame:
    return features.join(F.broadcast(marks), "doc_id").select("label", "x")


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, cut: float = CUT, most: int = LABELS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Texts are read once."""
    features = materialise_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_column(F.col("text")).alias("x")))
    model = fit(_training(features, _marks(labels, most)), shrinkage)
    scored = features.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, cut: float = CUT, most: int = LABELS) -> DataFrame:
    """``docs`` whose score is at least ``cut``, columns unchanged; texts move nowhere."""
    marks = _marks(labels, most)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")
    model = fit(known.select("label", statistics_column(F.col("text")).alias("x")), shrinkage)

    @F.pandas_udf(T.DoubleType())
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return docs.filter(score(F.col("text")) >= cut)
