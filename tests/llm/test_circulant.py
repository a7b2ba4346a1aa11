"""Circulant MinHash and its near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from tessella.llm import circulant, queries, shingles
from tests.llm.conftest import larger, same_as_sql

DOCS = "doc_id long, text string, id string, row string, n long, node string, key int, kept int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", 1, "c", 2, 3) for i, t in texts], DOCS)


def words_of(text, n=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(texts):
    """Rows (doc_id, n_shingles, component_id, kept) by all pairs."""
    sets = [words_of(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    rows = [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(texts)]
    return sorted(((*r, r[0] == r[2]) for r in rows), key=str)


def found(spark, texts, **limits):
    return sorted((tuple(r) for r in circulant.near_duplicates(frame(spark, texts), **limits).collect()), key=str)


def family(rng, size, base, edits):
    """Texts that differ from one of ``base`` words in up to ``edits`` of them."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    first = [word() for _ in range(base)]
    out = [" ".join(first)]
    for _ in range(size - 1):
        near = list(first)
        for at in rng.sample(range(base), rng.randrange(1, edits)):
            near[at] = word()
        out.append(" ".join(near))
    return out


def test_word_and_shingle_hashes_follow_words_alone():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abAé9-") for _ in range(rng.choice((1, 7, 8, 9, 16, 63, 64, 65, 300)))) for _ in range(2000))
    spaced = "\n\t " + text.replace(" ", " \r\n\x0b\x0c") + " "
    own = shingles.shingle_set(text.encode(), 4)
    assert len(own) == len(words_of(text)) and (own == shingles.shingle_set(spaced.encode(), 4)).all()
    assert len(shingles.word_hashes(text.encode())) == 2000
    a, b, c = (set(shingles.shingle_set(t, 4).tolist()) for t in (b"One two", b"one TWO ", b"two one"))
    assert a == b != c and len(a) == 1
    assert len(shingles.shingle_set(b"", 4)) == len(shingles.shingle_set(b" \n", 4)) == 0
    assert len(shingles.shingle_set("   ".encode(), 4)) == 1  # only ASCII white space parts words


@pytest.mark.parametrize("piece", [1, 17, 200, 1 << 20])
def test_pieces_do_not_change_the_set(piece, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(("a", "bb", "long" * 40, "d")) for _ in range(500)).encode()
    whole = shingles.shingle_set(text, 4)
    monkeypatch.setattr(shingles, "PIECE", piece)
    assert (shingles.shingle_set(text, 4) == whole).all()
    assert len(whole) == len(words_of(text.decode()))


def test_signatures_are_least_values_of_shifted_permutations():
    first, _ = circulant._tables()
    rng = np.random.default_rng(circulant.SEED)
    assert (first == rng.permutation(circulant.UNIVERSE)).all()
    second = rng.permutation(circulant.UNIVERSE)
    own = np.random.default_rng(3).integers(0, 1 << 63, 300).astype(np.uint64)
    places = first[(own % circulant.UNIVERSE).astype(int)].astype(int)
    want = [int(np.roll(second, -k)[places].min()) & 0xFFFF for k in range(0, circulant.COORDINATES, 9)]
    assert circulant.signature(own)[::9].tolist() == want
    assert (circulant.signature(own[:0]) == 0xFFFF).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(6)
    errors = []
    for _ in range(100):
        x, y = (rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(2))
        both = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = (circulant.signature(np.concatenate([both, z])) for z in (x, y))
        errors.append((a == b).mean() - 300 / 420)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("limits", [{}, {"pairs_up_to": 4, "block": 8}])
def test_planted_groups_equal_all_pairs(spark, limits):
    """Also where runs become stars and what a star leaves apart is compared in blocks."""
    rng = random.Random(7)
    texts = [t for size, base, edits in ((40, 120, 5), (60, 200, 13), (30, 80, 7), (12, 9, 2)) for t in family(rng, size, base, edits)]
    texts += [texts[3]] * 30 + ["x y", "X  y", "x", "", None, " \t", "one two three four", "one two three"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, "lonely words of a null id here"), (None, ""), (1000, texts[50]), (1000, texts[50]), (999, None)]
    rng.shuffle(rows)
    assert found(spark, rows, **limits) == expected(rows)


def test_chains_are_followed(spark):
    """Each text is near the next one only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    assert {r[2] for r in found(spark, rows)} == {0}
    assert found(spark, rows, pairs_up_to=2, block=4) == expected(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (None, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


@pytest.mark.parametrize("at", [str, larger])
def test_query_equals_its_sql(spark, sf, at, monkeypatch):
    same_as_sql(spark, at(sf), "op13_circulant")


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_circulant(spark, sf).collect()), key=str) == expected(rows)
