import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import queries, tokens

DOCS = "doc_id long, text string, n_tokens int, lang string"
ODD = [
    "", " ", "\n\n", "a", " a", "a ", "A<|endoftext|>B", "x <|startoftext|> y<|endoftext|>", "don't  we'll 's", "é ́x", "a b c　 d",
    "a\x1cb \x1f c\x85d", "ẛ̣ ﬁ Ω İİ", "tabs\t\tand\r\nlines\x0b\x0cend  ", "1234 5٥ ½", "日本語 한국 \U0001f600\U0001f468‍\U0001f469", "<|endoftext |>", "x" * 3000, "ΣΟΣ Σ aΣ",
]


def whole(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    encoder = Tokenizer.from_file(path)
    return lambda t: len(encoder.encode(t, add_special_tokens=False).ids)


def test_query_equals_the_library(spark, sf):
    got = {r.doc_id: r for r in queries.op4_tokens(spark, sf).collect()}
    count = whole("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = count(d.text or "")
        assert tuple(got[d.doc_id])[1:] == (len((d.text or "").encode()), n, n > 2048)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_texts_and_segments(spark, sf, name, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    count = whole(name)
    want = [count(t) for t in texts]
    assert tokens.counter(name)(texts) == want
    monkeypatch.setattr(tokens, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    monkeypatch.setattr(tokens, "CACHED_BYTES", 4)
    assert tokens.counter(name)(texts) == want


def test_odd_rows(spark):
    rows = [(1, None, 5, None), (None, "a b", 5, None), (2, "", 5, "en"), (2, "", 5, "en"), (3, "word " * 3000, 5, "en")]
    got = tokens.token_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        (0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True),
    ]
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).collect() == []
