import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import queries, simhash
from tessella.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_print(text, n):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """{id: fp} → {id: smallest id reachable}."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_print(t, 4) for i, t in texts.items()}
    roots = plain_components(prints)
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", roots[i])


@pytest.mark.parametrize("limit", [2, 4096])
def test_links_equal_brute_force_on_dense_groups(spark, limit):
    """Balls of fingerprints around a few centres, chains, and the way for long runs."""
    rng, values = random.Random(5), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
        for step in range(1, 6):  # a chain whose ends are far apart
            values.add(centre ^ sum(1 << 4 * step + k for k in range(4)))
    values |= {0, (1 << 64) - 1}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = simhash.fingerprint_links(df, run_limit=limit)
    roots = {r.u: r.root for r in connected_components(links).collect()}
    want = plain_components({s: v for v, s in signed.items()})
    assert len({roots.get(s, s) for s in signed.values()}) == len(set(want.values()))
    for a in signed.values():
        for b in signed.values():
            assert (roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b])


def test_forest_spans_in_blocks():
    values = np.array([0, 1, 3, 7, 15, 31, 7 << 40], np.uint64)
    u, v = simhash.forest(values, 1)
    assert set(u.tolist()) == {1, 3, 7, 15, 31} and set(v.tolist()) == {0}


def test_odd_rows(spark):
    long_text = "word " * 250_000
    rows = [
        (5, None, "en", None, None), (4, "", None, "s", 0), (None, "a b c d e", None, None, None),
        (9, "A b c D e", None, None, None), (9, "A b c D e", None, None, None), (7, long_text, None, None, None),
        (8, "  lone\x0bTWO ", None, None, None), (3, "x y Zİ", None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit(1)).withColumn("fp", F.lit("x"))
    got = simhash.near_duplicates(docs, shingle=4).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[4].fp == by_id[5].fp == 0 and by_id[5].component_id == by_id[4].component_id == 4
    assert by_id[None].component_id == by_id[9].component_id == 9
    assert by_id[8].fp % (1 << 64) == plain_print("lone two", 4)
    assert by_id[3].fp % (1 << 64) == plain_print("x y zİ", 4)
    assert by_id[7].fp % (1 << 64) == plain_print(long_text, 4)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7, 8, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []
