"""The tokenizer boundary: what packing, token budgets and word ranks need of a tokenizer.

``WhiteSpace`` is column expressions and numbers a word by its length; ``Library`` wraps a
``tokenizers`` file, encoding Arrow batches on the executors, each of which loads it once.
Anything with the same three methods and two fields serves as well."""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.config import is_absent

WHITE_SPACE = "whitespace"
#: Rank of a word that has no token.
LAST = 10**12


class Tokenizer(Protocol):
    eos: str | None
    pad: str | None

    def ids(self, text: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...

    def within(self, text: Column, spans: Column) -> Column:
        """For each span (from, to) of characters (from 0), the same of tokens: those that share
        a character with it, or none at the place where they would be."""
        ...


def _span(first: Column, after: Column) -> Column:
    return F.struct(first.cast("int").alias("from"), after.cast("int").alias("to"))


class WhiteSpace:
    """Words between white space (Unicode's); a word's number is its length."""

    def __init__(self, eos: str | None = " <eos>", pad: str | None = None):
        self.eos, self.pad = eos, eos if pad is None else pad

    def words(self, text: Column) -> Column:
        return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def ids(self, text: Column) -> Column:
        return F.transform(self.words(text), lambda w: F.length(w))

    def count(self, text: Column) -> Column:
        return F.size(self.words(text)).cast("bigint")

    def within(self, text: Column, spans: Column) -> Column:
        begun = lambda at: F.size(self.words(F.substring(text, F.lit(1), at)))
        cut = lambda at: F.substring(text, at, F.lit(2)).rlike(r"(?U)\A\S\S\z").cast("int")  # a word goes on past ``at``
        whole = lambda at: begun(at) - F.when(at > 0, cut(at)).otherwise(0)
        empty = lambda s: s["from"] >= s["to"]
        return F.transform(spans, lambda s: _span(whole(s["from"]), F.when(empty(s), whole(s["from"])).otherwise(begun(s["to"]))))


_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The library's encoder of a file, loaded once in a process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer as Encoder

        _LOADED[path] = Encoder.from_file(path)
        _LOADED[path].no_truncation()
        _LOADED[path].no_padding()
    return _LOADED[path]


class Library:
    """A ``tokenizers`` JSON file that every executor can read, without special tokens."""

    def __init__(self, path: str, eos: str | None = None, pad: str | None = None):
        self.path, self.eos, self.pad = path, eos, eos if pad is None else pad

    def _encoded(self, text: Column, kind: T.DataType, of) -> Column:
        path = self.path

        @F.pandas_udf(kind)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            library = encoder(path)
            for texts in series:
                found = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
                yield pd.Series([of(e.ids) for e in found], index=texts.index)

        return run(text)

    def ids(self, text: Column) -> Column:
        return self._encoded(text, T.ArrayType(T.IntegerType()), list)

    def count(self, text: Column) -> Column:
        return self._encoded(text, T.LongType(), len)

    def within(self, text: Column, spans: Column) -> Column:
        path = self.path

        @F.pandas_udf("array<struct<from int, to int>>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            library = encoder(path)
            for texts, asked in batches:
                found = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
                out = []
                for e, own in zip(found, asked):
                    starts, ends = ([o[k] for o in e.offsets] for k in (0, 1))
                    first = lambda s: bisect_right(ends, s["from"])  # noqa: B023, E731
                    out.append([{"from": first(s), "to": max(first(s), bisect_left(starts, s["to"])) if s["from"] < s["to"] else first(s)} for s in ([] if own is None else own)])
                yield pd.Series(out, index=texts.index)

        return run(text, spans)


def load(name: str, eos: str | None = None, pad: str | None = None) -> Tokenizer:
    """By name: white space, or the path of a library file. Padding falls back on the end mark."""
    if is_absent(name):
        raise ValueError("a tokenizer must be named")
    if name == WHITE_SPACE:
        return WhiteSpace(*([eos] if eos is not None else []), pad=pad)
    return Library(name, eos, pad)


def from_config(cfg: dict) -> Tokenizer:
    model = cfg["model"]
    name = model.get("tokenizer_name_or_path")
    return load(model["name_or_path"] if is_absent(name) else name, model.get("eos_token"), model.get("pad_token"))


def require_end(tokenizer: Tokenizer, chat_template: str | None) -> None:
    """Question rows need a chat template and a mark of their end."""
    if is_absent(chat_template):
        raise ValueError("a chat template is needed")
    if tokenizer.eos is None:
        raise ValueError("the tokenizer has no end mark")


def word_rank(tokenizer: Tokenizer, word: Column, single: bool = True) -> Column:
    """The number of a word's first token as it stands in running text, after a space: LAST
    without any, null if it must be ``single`` and is not."""
    ids = tokenizer.ids(F.concat(F.lit(" "), word))
    rank = F.coalesce(F.get(ids, F.lit(0)).cast("bigint"), F.lit(LAST))
    return F.when(F.size(ids) == 1, rank) if single else rank
