import hashlib
import re

import pytest

from tessella.llm import decontaminate, queries
from tests.llm.conftest import larger, same_as_sql

DOCS = "doc_id long, text string, _k0 int, h string"
ITEMS = "item_id long, text string, h int"


def plain(docs, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)] by direct search."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = set()
    for i, t in items:
        w = words(t)
        wins |= {(i, tuple(w[k : k + window])) for k in range(max(1, len(w) - window + 1))} if w else set()
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


LINE = "one two three four five six seven eight nine ten eleven twelve"
ODD_DOCS = [
    (1, None), (2, ""), (3, LINE), (4, LINE.upper().replace(" ", "--")), (5, "x " + LINE + " y " + LINE), (6, "...!!"), (None, LINE),
    (7, "Short one"), (8, "a short one b short one"), (9, "ΑΣ. K İx a K"), (10, "ας k i̇x"), (11, "1 2 3 one two three four"), (3, LINE), (3, "other"),
    (12, "word " * 60_000 + LINE), (13, "  lead " + LINE.replace("six", "6") + "\n"),
]
ODD_ITEMS = [(1, LINE), (10, LINE), (2, "short ONE"), (3, None), (4, "--"), (None, "1 2 3"), (5, "ας"), (2, "three  four"), (9, "K"), (9, "k i̇x")]


@pytest.mark.parametrize("bound", [0, 10**6])
def test_odd_rows_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD_DOCS], DOCS)
    items = spark.createDataFrame([(*r, 1) for r in ODD_ITEMS], ITEMS)
    want = key(plain(ODD_DOCS, ODD_ITEMS))
    assert key(decontaminate.report(docs, items).collect()) == want
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want if not r[-1])
    assert {r.doc_id for r in decontaminate.spans(docs, items).collect()} == {r[0] for r in want if r[-1]}


def test_query_equals_brute_force_and_sql(spark, sf):
    sf = larger(sf)
    read = lambda n, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(c, "text").limit(150).collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    got = {r.doc_id: tuple(r) for r in queries.op6_decontamination(spark, sf).collect()}
    for row in plain(docs, items):
        assert got[row[0]] == row
    assert any(r[-1] for r in got.values())
    same_as_sql(spark, sf, "op6_decontamination")


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, LINE, 1, "x")], DOCS)
    assert decontaminate.report(docs, items).collect() == []
    assert [r.contaminated for r in decontaminate.report(some, items).collect()] == [False]
    assert decontaminate.drop_contaminated(some, items).count() == 1


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op6_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
