"""What a question row is trained on: its text through a chat template, its tokens, and labels.

The template marks the spans that the assistant is to learn, in characters of the text; the
tokenizer's own offsets carry them over to tokens. A token that shares a character with a
span has its number as label, every other ``IGNORED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.tokenizers import Tokenizer, require_end
from tessella.operators.corpus import chat_template_text

#: Label of what is not learned; a fixed value.
IGNORED = -100


def chat_pieces(messages: Column, template: str, eos: str) -> Column:
    """array<struct<text, learn>>: the text of ``messages`` (role, content) in pieces, and which of
    them stand in the template's generation marks."""
    chat_template_text(template)  # refuses names that are unknown
    piece = lambda text, learn: F.struct(text.alias("text"), F.lit(learn).alias("learn"))
    content = lambda m: F.coalesce(m.content, F.lit(""))
    line = F.lit("\n")

    def plain(m: Column) -> Column:
        said = F.array(piece(F.lit("A: "), False), piece(F.concat(content(m), F.lit(eos)), True), piece(line, False))
        return F.when(m.role == "user", F.array(piece(F.concat(F.lit("Q: "), content(m), line), False))).when(m.role == "assistant", said).otherwise(F.filter(said, lambda _: F.lit(False)))

    def chatml(m: Column) -> Column:
        head = piece(F.concat(F.lit("<|im_start|>"), F.coalesce(m.role, F.lit("")), line), False)
        said = F.concat(content(m), F.lit("<|im_end|>"))
        return F.when(m.role == "assistant", F.array(head, piece(F.concat(said, F.lit(eos)), True), piece(line, False))).otherwise(F.array(head, piece(F.concat(said, line), False)))

    return F.flatten(F.transform(F.coalesce(messages, F.array().cast("array<struct<role string, content string>>")), plain if template == "plain" else chatml))


def learned_spans(pieces: Column) -> Column:
    """array<struct<from, to>>: the characters of the pieces to be learned."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from int, to int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        after = s["at"] + F.length(p.text)
        span = F.struct(s["at"].alias("from"), after.alias("to"))
        return F.struct(after.alias("at"), F.when(p.learn, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def with_loss_labels(rows: DataFrame, tokenizer: Tokenizer, template: str, max_length: int | None = None) -> DataFrame:
    """``rows`` (messages, ...) with ``text``, ``input_ids`` and ``labels``, both cut to
    ``max_length``. A row without an assistant turn has no label but ``IGNORED``."""
    require_end(tokenizer, template)
    pieces = rows.withColumn("_pieces", chat_pieces(F.col("messages"), template, tokenizer.eos))
    text = F.array_join(F.transform("_pieces", lambda p: p.text), "")
    spread = pieces.withColumns({"text": text, "_spans": learned_spans(F.col("_pieces"))})
    tokens = spread.withColumns({"input_ids": tokenizer.ids(F.col("text")), "_within": tokenizer.within(F.col("text"), F.col("_spans"))})
    learned = lambda i: F.exists("_within", lambda s: (i >= s["from"]) & (i < s["to"]))
    out = tokens.withColumn("labels", F.transform("input_ids", lambda t, i: F.when(learned(i), t).otherwise(IGNORED)))
    if max_length is not None:
        out = out.withColumns({c: F.slice(c, 1, max_length) for c in ("input_ids", "labels")})
    return out.drop("_pieces", "_spans", "_within")


def collated(rows: DataFrame, tokenizer_pad: int, batch: str = "batch") -> DataFrame:
    """Rows of a ``batch`` padded to its longest: ``input_ids`` with the pad, ``labels`` with
    ``IGNORED``, and ``attention_mask``."""
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_longest"))
    wide = rows.join(longest, batch)
    short = F.col("_longest") - F.size("input_ids")
    pad = lambda c, value: F.concat(c, F.array_repeat(F.lit(value), short))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), short))
    return wide.withColumns({"attention_mask": mask, "labels": pad("labels", IGNORED), "input_ids": pad("input_ids", tokenizer_pad)}).drop("_longest")
