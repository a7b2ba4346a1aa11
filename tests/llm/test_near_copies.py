"""Removal of near copies by shingle similarity, against all pairs."""

import random

import numpy as np
import pytest

from tessella.llm import minhash, simhash, sketches
from tests.llm.conftest import same_as_sql

DOCS = "doc_id long, text string, id string, row string, n_chars long"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_all_pairs(texts, least):
    """{id: text} → ids that stay, linking every pair of at least that similarity."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            if jaccard(sets[a], sets[b]) >= least:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i for i in ids if find(i) == i}


def made(spark):
    """Sources with near copies of up to 4 changed words, far copies, exact copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts, clean, copies = {}, set(), set()
    for g in range(12):
        base = [word() for _ in range(300)]
        first = 100 * g
        texts[first] = " ".join(base)
        clean.add(first)
        for k in range(1, 31):
            near = list(base)
            for at in rng.sample(range(300), rng.randrange(1, 5)):  # similarity of 0.87 at least
                near[at] = word()
            texts[first + k] = " ".join(near)
            copies.add(first + k)
        far = [word() if rng.random() < 0.2 else w for w in base]
        texts[first + 50] = " ".join(far)
        clean.add(first + 50)
        texts[first + 60] = texts[first + 3]
        copies.add(first + 60)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS), clean, copies


@pytest.mark.parametrize("limit", [4096, 20])
def test_planted_copies_go_and_clean_documents_stay(spark, limit):
    """Also where groups are beyond the limit and dealt by bands and parts."""
    docs, clean, copies = made(spark)
    _, kept = simhash.near_copies(docs, group_limit=limit)
    got = {r.id for r in kept.collect()}
    assert clean <= got
    assert len(got & copies) <= 0.01 * len(copies)


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert got == kept_by_all_pairs(texts, 0.8)


def test_minhash_classes_equal_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows} | {10_000: None, 10_001: "", 10_002: "one two", 10_003: "One  two", 10_004: rows[0].text}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert got.keys() == texts.keys()
    assert {i for i, r in got.items() if r.component_id == i} == kept_by_all_pairs(texts, 0.8)
    distinct = {frozenset(shingles(t)) for t in texts.values()}
    for i, r in list(got.items())[::7]:
        mine = shingles(texts[i])
        assert r.n_links == sum(jaccard(mine, s) >= 0.8 for s in distinct if s != mine)


def test_classes_equal_sql(spark, sf):
    same_as_sql(spark, sf, "minhash_near_duplicates")


def test_simhash_proposes_what_bands_miss(spark):
    """Fingerprints within the radius are proposed by themselves, without any band."""
    texts = {i: t for i, t in edited(copies=60).items() if i < 1000}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    prints, _ = minhash.printed(docs, 5, fingerprint=lambda t: simhash.simhash(t, 5))
    rows = prints.collect()
    near = {(a.node, b.node) for a in rows for b in rows if a.node < b.node and ((a.fp ^ b.fp) & simhash._MASK).bit_count() <= simhash.RADIUS}
    for limit in (4096, 3):  # the second: by balls of the whole fingerprint
        pairs = simhash._proposed(prints, simhash.RADIUS, limit).collect()
        root = {r.node: r.node for r in rows}
        for _ in rows:
            for u, v in pairs:
                root[u] = root[v] = min(root[u], root[v])
        assert near and all(root[u] == root[v] for u, v in near)


def test_alike_counts_equal_values():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (40, 256)).astype(np.uint16)
    want = (x[:, None] == x[None]).mean(axis=2) >= 0.34
    assert (sketches.alike(x, 0.34) == want).all()


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (None, "x y z"), (None, "other text"), (7, long), (8, long), (9, "same id"), (9, "same id"), (9, "not the same")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert got == ["1", "3", "7", "9", "None"]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def edited(seed=5, copies=200):
    """One base of 300 words with copies of 1 to 7 changed words, whose similarities to each
    other lie on both sides of 0.8, and bases with a tail cut off, down to 0.8 and below."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(300)]
    texts = {0: " ".join(base)}
    for k in range(1, copies + 1):
        near = list(base)
        for at in rng.sample(range(300), rng.randrange(1, 8)):
            near[at] = word()
        texts[k] = " ".join(near)
    for g in range(60):
        whole = [word() for _ in range(100)]
        texts[1000 + 2 * g] = " ".join(whole)
        texts[1001 + 2 * g] = " ".join(whole[: 76 + g % 20])
    return texts


def test_long_runs_lose_no_link(spark):
    texts = edited()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    sets = {i: shingles(t) for i, t in texts.items()}
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i for i, r in got.items() if r.component_id == i} == kept_by_all_pairs(texts, 0.8)
    for i in texts:
        assert got[i].n_links == sum(jaccard(sets[i], x) >= 0.8 for x in sets.values() if x != sets[i])


def test_cut_texts_are_near_copies(spark):
    """Texts whose end is cut off change their word set as much as their shingles."""
    texts = {i: t for i, t in edited().items() if i >= 1000}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    _, kept = simhash.near_copies(docs)
    assert {r.id for r in kept.collect()} <= kept_by_all_pairs(texts, 0.8)


def test_parts_of_long_runs_meet(spark):
    """Pairs in different parts of a run beyond the limit are compared as well."""
    texts = edited(copies=100)
    sets = {i: shingles(t) for i, t in texts.items()}
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, pairs_up_to=8, block=16).collect()}
    assert {i for i, r in got.items() if r.component_id == i} == kept_by_all_pairs(texts, 0.8)
    for i in texts:
        assert got[i].n_links == sum(jaccard(sets[i], x) >= 0.8 for x in sets.values() if x != sets[i])


def test_similarity_is_counted(spark):
    """What is at 0.8 or just above goes, what is just below stays."""
    texts = edited()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], DOCS)
    _, kept = simhash.near_copies(docs)
    assert {r.id for r in kept.collect()} == kept_by_all_pairs(texts, 0.8)


def test_stage_keeps_distinct_rows_of_one_id(spark):
    rows = [(None, "x y z"), (None, "other text"), (None, "other  text"), (9, "same id"), (9, "same id"), (9, "not the same"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = simhash.keep_documents(docs).collect()
    near = sorted((str(r.doc_id), " ".join((r.text or "").split())) for r in got)
    assert near == [("3", ""), ("9", "not the same"), ("9", "same id"), ("None", "other text"), ("None", "x y z")]
