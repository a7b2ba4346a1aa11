r"""Parsing and matching of generated answers. White space is Unicode's (``(?U)\s``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = ("<|im_end|>", "<|im_start|>")
LABELS = "answer|answers|cause set|causes|outcome|effect"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def without_special(text: Column, eos: str | None = "<eos>", pad: str | None = "<eos>") -> Column:
    for token in (eos, pad, *SPECIAL):
        if token:
            text = F.replace(text, F.lit(token), F.lit(""))
    return text


def truncated(text: Column) -> Column:
    """Up to the first line end or full stop."""
    return strip(F.regexp_extract(text, r"\A[^\n\r.]*", 0))


def normalised(item: Column) -> Column:
    return F.btrim(F.regexp_replace(strip(F.lower(item)), r"(?U)\s+", " "), F.lit(" .,:;!?\"'`"))


def items(text: Column, eos: str | None = "<eos>") -> Column:
    """The answer's parts: one leading label goes, then commas, semicolons, slashes and the
    word "and" (lower case only) separate."""
    cut = truncated(without_special(F.coalesce(text, F.lit("")), eos, eos))
    bare = F.regexp_replace(cut, rf"(?iU)\A\s*({LABELS})\s*:\s*", "")
    parts = F.split(bare, r"(?U)[,;/]|\band\b")
    return F.filter(F.transform(parts, normalised), lambda x: x != "")


def same_set(predicted: Column, gold: Column) -> Column:
    """Equal as sets; an empty prediction is never right."""
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    return (F.size(predicted) > 0) & (tidy(predicted) == tidy(gold))
