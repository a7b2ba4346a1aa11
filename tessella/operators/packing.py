"""Packing a token stream, in row order, into blocks of one size; the tail is dropped.

The stream's order is that of a key, such as a document id; rows of one key follow the hash
of their tokens, so repeated keys have one order as well, and a null key comes first. Texts
are tokenised once. Each document's offset is an exact prefix sum in two levels: key ranges
are summed each in its own task, their totals form a table of a row for each range, and
within a range a running sum is added. A document is then cut at block boundaries, so no
task sees more than a range of documents or a block of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import materialise

#: Ranges of keys: one for so many rows, but not fewer or more than these.
ROWS, LEAST, MOST = 1_000_000, 64, 16_384


def whitespace_tokens(text: Column) -> Column:
    """Non-empty parts between white space (Unicode's)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _place(key: Column, cuts: list[int]) -> Column:
    """Number of the sorted cuts at or below key, by binary search in one constant."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2)
        return F.when(s.lo >= s.hi, s).when(key < F.get(held, mid.cast("int")), span(s.lo, mid)).otherwise(span(mid + 1, s.hi))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    found = F.aggregate(steps, span(F.lit(0), F.lit(len(cuts))), halve, lambda s: s.lo)
    return F.when(key.isNull(), 0).otherwise(found)


def offsets(df: DataFrame, key: str, size: str, within: list[str] | None = None, tie: Column | None = None) -> DataFrame:
    """Adds ``offset``, the sum of ``size`` over the rows before, in order of ``key`` (BIGINT)
    and then ``tie``, per ``within`` group. ``df`` is read twice."""
    groups = within or []
    ranges = min(max(LEAST, df.count() // ROWS), MOST)
    bounds = df.filter(F.col(key).isNotNull()).approxQuantile(key, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))
    marked = df.withColumn("_range", _place(F.col(key), sorted({int(b) for b in bounds or []}))).withColumn("_tie", F.lit(0) if tie is None else tie)
    sums = marked.groupBy(*groups, "_range").agg(F.sum(size).alias("_sum"))
    order = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_range")
    before = sums.select(*groups, "_range", (F.sum("_sum").over(order) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*groups, "_range").orderBy(key, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(size).over(inside) - F.col(size)
    out = marked.withColumn("_own", running).join(F.broadcast(before) if not groups else before, [*groups, "_range"])
    return out.withColumn("offset", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_range", "_before", "_own", "_tie")


def pack(docs: DataFrame, block: int, key: str = "doc_id", tokens: str = "tokens", within: list[str] | None = None) -> DataFrame:
    """(within..., block_index, input_ids): whole blocks of the concatenated ``tokens``."""
    groups = within or []
    sized = materialise(docs.select(*groups, key, tokens).withColumn("n", F.size(tokens).cast("bigint")).filter("n > 0"))
    return cut(offsets(sized, key, "n", groups, F.xxhash64(tokens)), block, tokens, groups)


def cut(spread: DataFrame, block: int, tokens: str = "tokens", within: list[str] | None = None) -> DataFrame:
    """``pack`` of rows that know their ``offset`` and their number ``n`` of tokens."""
    groups = within or []
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n") - 1) / block)
    pieces = spread.withColumn("block_index", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block_index") * block - F.col("offset"), F.lit(0))
    stop = F.least((F.col("block_index") + 1) * block - F.col("offset"), F.col("n"))
    piece = F.slice(tokens, (start + 1).cast("int"), (stop - start).cast("int"))
    parts = pieces.select(*groups, "block_index", F.struct((F.col("offset") + start).alias("at"), piece.alias("t")).alias("p"))
    whole = parts.groupBy(*groups, "block_index").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select(*groups, "block_index", F.flatten(F.transform("ps", lambda p: p.t)).alias("input_ids")).filter(F.size("input_ids") == block)


def accepted(texts: DataFrame, key: str, text: str = "text", max_records: int | None = None) -> DataFrame:
    """Rows whose text is not blank; with ``max_records`` the first so many in order of key."""
    kept = texts.filter(not_blank(F.col(text)))
    if max_records is None:
        return kept
    return kept.orderBy(key, F.xxhash64(text)).limit(max_records)


def with_labels(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("labels", F.col("input_ids"))


def assert_train_blocks(blocks: DataFrame) -> None:
    """No whole train block is an error; no validation block is an empty split."""
    if blocks.filter("split = 'train'").isEmpty():
        raise ValueError("the train split has no whole block")


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("split").agg(F.count("*").alias("blocks"), F.sum(F.size("input_ids")).cast("bigint").alias("tokens"))
