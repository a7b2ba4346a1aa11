import hashlib
import re

import numpy as np

from tessella.llm import minhash, queries

DOCS = "doc_id long, text string, _bucket int, n_chars long"


def shingles(text, n=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.op5_minhash(spark, sf).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert len(got) == len(docs)
    off, next_off = [], []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k, r = len(text) // 2, got[i]
        edited = text[: len(text) - k] + after[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == minhash.as_text(minhash.signature(text))
        assert r.edited_fingerprint == minhash.as_text(minhash.signature(edited))
        off.append(r.near_edited - jaccard(shingles(text), shingles(edited)))
        next_off.append(r.near_next - jaccard(shingles(text), shingles(after)))
    # a signature of 128 has a standard error of 0.044 at one half
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.01 and np.abs(next_off).max() < 0.1


def test_blocks_change_nothing():
    text = " ".join(f"w{i * i % 9973}" for i in range(20_000))
    a, b = minhash._family(128)
    least = None
    for h in minhash.shingle_hashes(text.encode().split()):
        for x in h:
            v = a[:, 0] * x + b[:, 0]
            least = v if least is None else np.minimum(least, v)
    assert (minhash.signature(text) == least.astype(np.uint16)).all()


def test_odd_rows(spark):
    rows = [
        (3, "a b c d e f g", 1, None), (None, "x", 1, None), (7, None, 1, None), (7, None, 1, None), (9, "", 1, 0),
        (12, "word " * 300_000, None, None), (2, "Tie", 0, 0), (2, "tie", 0, 0),
    ]
    got = minhash.edited_likeness(spark.createDataFrame(rows, DOCS)).collect()
    order = sorted(((i if i is not None else -(1 << 63), t or "") for i, t, *_ in rows))
    assert len(got) == len(rows)
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = minhash.half_replaced(t, nxt)
        want.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[7, 0].near_next == 1.0 and by[9, 0].near_next == 0.0 and by[9, 0].near_edited == 1.0
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 1


def test_one_row_and_none(spark):
    one = minhash.edited_likeness(spark.createDataFrame([(5, "a b c d e f", 0, 0)], DOCS)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert minhash.edited_likeness(spark.createDataFrame([], DOCS)).collect() == []
