"""Token counts, by the tokenizer library's own encoder, in Arrow functions that
return lengths only.

A text is cut before white space, where no pre-token, normalisation or special string
of the supported vocabularies reaches across; the pieces that a worker has not met are
encoded in batches of about ``BATCH_BYTES``, whatever the number or length of texts,
and a text's count is the sum over its pieces. Texts are taken up about
``SEGMENT_BYTES`` at a time, a longer one in several goes, so memory follows neither
the longest text nor the rows of an Arrow batch. SentencePiece models see each text
whole, as their own normaliser may join what white space parts.

Rows: null counts as empty (no bytes, no tokens); repeated rows keep a row each; any
doc_id, null included, is only carried.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
BATCH_BYTES = 256 << 10
SEGMENT_BYTES = 1 << 20
CACHE_PIECES = 200_000
CACHED_BYTES = 64  # longer pieces are encoded each time

_SPACE = b" \t\n\r\x0b\x0c"
_WITH_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+\Z")

_COUNTERS: dict[str, Callable] = {}


def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the file of the installed vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _drops_space(spec: dict) -> bool:
    """Whether the pre-tokenizer keeps only what its pattern matches, white space not."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return any(
        s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s" in str(s.get("pattern"))
        for s in steps
    )


def _segments(raw: bytes) -> Iterator[bytes]:
    """Parts of about SEGMENT_BYTES, each but the first starting with white space that
    follows a word; a part without such a place stays whole."""
    at = 0
    while len(raw) - at > SEGMENT_BYTES:
        cut = re.compile(rb"(?<=[^ \t\n\r\x0b\x0c])[ \t\n\r\x0b\x0c]").search(raw, at + SEGMENT_BYTES)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


class PieceCounter:
    """Counts of whole texts by a ``tokenizers`` file, summed over cached pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        with open(path, encoding="utf-8") as f:
            self.split = bytes.split if _drops_space(json.load(f)) else _WITH_SPACE.findall
        self.known: dict[bytes, int] = {}

    def _encode(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        batch: list[bytes] = []
        size = 0

        def run():
            found = self.encoder.encode_batch_fast([p.decode("utf-8", "replace") for p in batch], add_special_tokens=False)
            out.update(zip(batch, map(len, found)))

        for p in pieces:
            batch.append(p)
            size += len(p)
            if size >= BATCH_BYTES:
                run()
                batch, size = [], 0
        if batch:
            run()
        return out

    def _settle(self, group: list[tuple[int, list[bytes]]], counts: list[int]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        new = {p for _, pieces in group for p in pieces if p not in known}
        fresh = self._encode(new)
        known.update((p, n) for p, n in fresh.items() if len(p) <= CACHED_BYTES)
        long = {p: n for p, n in fresh.items() if len(p) > CACHED_BYTES}
        for i, pieces in group:
            counts[i] += sum(known[p] if p in known else long[p] for p in pieces) if long else sum(map(known.__getitem__, pieces))

    def __call__(self, texts: Iterable[str | None]) -> list[int]:
        counts: list[int] = []
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, text in enumerate(texts):
            counts.append(0)
            for part in _segments((text or "").encode("utf-8", "replace")):
                group.append((i, self.split(part)))
                held += len(part)
                if held >= SEGMENT_BYTES:
                    self._settle(group, counts)
                    group, held = [], 0
        self._settle(group, counts)
        return counts


class WholeCounter:
    """Counts by a SentencePiece model, texts whole, batches balanced by bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: Iterable[str | None]) -> list[int]:
        counts: list[int] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= BATCH_BYTES:
                counts += map(len, self.encoder.encode(batch, num_threads=1))
                batch, size = [], 0
        return counts + [len(x) for x in self.encoder.encode(batch, num_threads=1)] if batch else counts


def counter(vocabulary: str) -> Callable[[Iterable[str | None]], list[int]]:
    """The worker's counter for a vocabulary, made once."""
    if vocabulary not in _COUNTERS:
        kind = WholeCounter if vocabulary.endswith(".model") else PieceCounter
        _COUNTERS[vocabulary] = kind(vocabulary_path(vocabulary))
    return _COUNTERS[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf(T.LongType())
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary)
        for texts in series:
            yield pd.Series(count(texts), dtype="int64")

    return of(text)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
