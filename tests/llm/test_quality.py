import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality, queries
from tests.llm.conftest import larger

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, sf):
    sf = larger(sf)
    got = queries.op8_quality(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.iterrows())
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].join(labels.quality, how="inner")
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95
    assert (held[held.quality == 1].predicted == 1).mean() >= 0.97


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    data = [(k, (rng.normal(k, 1 + k, d)).tolist()) for k in (0, 1) for _ in range(40)]
    model = quality.fit(spark.createDataFrame([*data, (None, [0.0] * d), (5, [0.0] * d)], "label int, x array<double>"), 0.2)
    x = np.array([v for _, v in data])
    y = np.array([k for k, _ in data])
    covs = [np.cov(x[y == k].T) for k in (0, 1)]
    target = np.diag(np.diag((covs[0] + covs[1]) / 2))
    logs = []
    for k in (0, 1):
        s = 0.8 * covs[k] + 0.2 * target
        z = x - x[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def plain_scores(docs, labels, shrinkage=quality.SHRINKAGE):
    """[(id, text)], [(id, label)] → scores by numpy, one document at a time."""
    x = {k: np.array(quality.statistics(t)) for k, (_, t) in enumerate(docs)}
    train = {(k, y) for k, (i, _) in enumerate(docs) for j, y in labels if i is not None and i == j and y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    data = [np.array([x[k] for k, y in sorted(train) if y == c]) for c in (0, 1)]
    n = [len(d) for d in data]
    covs = [np.cov(d.T) for d in data]
    target = np.diag(np.maximum(np.diag(sum(c * (m - 1) for c, m in zip(covs, n)) / (sum(n) - 2)), 1e-6))
    out = []
    for k in x:
        logs = []
        for c in (0, 1):
            s = (1 - shrinkage) * covs[c] + shrinkage * target
            z = x[k] - data[c].mean(0)
            logs.append(np.log(n[c] / sum(n)) - 0.5 * z @ np.linalg.solve(s, z) - 0.5 * np.linalg.slogdet(s)[1])
        out.append(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    for (i, _), score in zip(docs, plain_scores(docs, labels)):
        assert abs(got[i].score - score) < 1e-6 and got[i].predicted == (got[i].score >= 0.3)


def test_repeated_rows_and_labels(spark):
    rng = np.random.default_rng(4)
    text = lambda good: " ".join(("river" if good else "XX!!") + "a" * rng.integers(1, 9) for _ in range(rng.integers(5, 60)))
    docs = [(i, text(i % 2)) for i in range(60)]
    docs += [docs[1], docs[1], (7, "another text of one id")]
    labels = [(i, i % 2) for i in range(60)] + [(1, 1), (1, 1), (2, 1), (3, None), (4, 9)]
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    marks = spark.createDataFrame([(i, y, 0) for i, y in labels], LABELS)
    got = sorted((r.doc_id, round(r.score, 6)) for r in quality.scores(frame, marks).collect())
    assert got == sorted((i, round(s, 6)) for (i, _), s in zip(docs, plain_scores(docs, labels)))
    kept = sorted((r.doc_id, r.text) for r in quality.keep_good(frame, marks).collect())
    assert kept == sorted(d for d, s in zip(docs, plain_scores(docs, labels)) if s >= quality.CUT)
    few = quality._marks(marks, 20).count()
    known = {(i, y) for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    assert 5 < few < 40 and sorted(map(tuple, quality._marks(marks, 1000).collect())) == sorted(known)


def test_odd_rows(spark):
    good, bad = "The quiet river ran past the old mill. ", "XX!! ### YY!! $$$ "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 7), "en", "s", None) for i in range(60)]
    rows += [(None, good * 5, None, None, None), (100, None, None, None, None), (101, "", None, None, None), (3, good * 6, "en", "s", None), (102, "a" * 200_000, None, None, None)]
    labels = [(i, i % 2, 0) for i in range(60)] + [(None, 0, 0), (1, None, 0), (2, 7, 0), (9999, 1, 1), (4, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("quality", F.lit(0))
    marks = spark.createDataFrame(labels, LABELS)
    got = quality.scores(docs, marks).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60} == set(range(1, 60, 2))


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 1)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.scores(docs, none).collect()] == [0.5]
    assert quality.scores(spark.createDataFrame([], DOCS), none).collect() == []
    only = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality.keep_good(docs, only).count() == 1
