from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, quality, queries, simhash
from tests.llm.conftest import larger
from tests.llm.test_decontaminate import plain as plain_report
from tests.llm.test_near_copies import kept_by_all_pairs


def test_stages_equal_brute_force(spark, sf):
    sf = larger(sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scored = {r.doc_id: r.predicted for r in queries.op8_quality(spark, sf).collect()}

    good = {i for i in texts if scored[i] == 1}
    single = {r.doc_id for r in simhash.keep_one(docs.filter(F.col("doc_id").isin(good))).collect()}
    assert single == kept_by_all_pairs({i: texts[i] for i in good}, 0.8)  # near copies go, and nothing else
    dirty = {r.doc_id for r in queries.op6_decontamination(spark, sf).collect() if r.contaminated}
    clean = single - dirty
    some = sorted(single)[:60] + sorted(single & dirty)
    assert {r[0] for r in plain_report([(i, texts[i]) for i in some], items) if r[-1]} == dirty & set(some)

    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == clean
    tokens = {r.doc_id: r.n_tokens for r in queries.op4_tokens(spark, sf).collect()}
    for i in clean:
        assert sum(r.size for r in rows if r.doc_id == i) == tokens[i]
    bins = {r.bin: r.bin_used for r in rows}
    assert max(bins.values()) <= 2048 and sum(bins.values()) == sum(r.size for r in rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    assert all((quality.keep_good, simhash.keep_one, decontaminate.drop_contaminated))


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
