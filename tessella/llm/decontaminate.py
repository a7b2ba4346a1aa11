"""Benchmark decontamination with a broadcast set of benchmark windows.

Words are maximal runs of digits, letters and non-ASCII characters after A-Z are
lower-cased. A window is ``WINDOW`` consecutive words of an item; an item of fewer
words, but not none, is one window. The windows' hashes are broadcast; each document
generates the hashes of its own word windows inside the scan's stage, what meets the
set is compared word by word, and only positions that match leave the stage, with one
row for each document. All of it is DataFrame expressions.

The set is broadcast while its words and item ids hold at most ``BROADCAST_BYTES`` (summed
first); a larger one is joined by shuffle, with the same result.

Rows: null text has no words; documents that repeat id and text keep a row each;
items repeating an item_id count once; windows of an item with a null id hit words but
are no item; without items or documents nothing is hit or returned.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BROADCAST_BYTES = 64 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words in order. Only the first and last part of the split can be empty."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), _SEPARATORS)
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h long, win array<string>, items array<long>), a row for each distinct window."""
    item = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (
        item.select("item_id", "w", F.explode(starts).alias("p"))
        .select("item_id", F.slice("w", F.col("p"), F.lit(window)).alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item_id").alias("items"))
        .select(F.xxhash64("win").alias("h"), "win", "items")
    )


def _hits(docs: DataFrame, windows: DataFrame, keys: list[Column], base: bool) -> DataFrame:
    """Rows (keys..., n_words, p, size, items): one for each window found, and with
    ``base`` one more for each document, of null p."""
    held = F.octet_length(F.array_join("win", " ")) + F.size("win") * 16 + (F.size("items") * 8 if "items" in windows.columns else F.lit(0)) + 64
    found = windows.agg(F.sum(held).alias("bytes"), F.collect_set(F.size("win")).alias("sizes")).first()
    sizes = sorted(found["sizes"]) or [WINDOW]
    m = len(sizes)
    names = [f"_k{i}" for i in range(len(keys))]
    spread = docs.select(*[k.alias(n) for k, n in zip(keys, names)], words(F.col("text")).alias("_w")).select(
        *names, "_w", F.size("_w").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("_w") * m - 1)).alias("_k")
    )
    size = F.get(F.array(*map(F.lit, sizes)), F.pmod("_k", F.lit(m))) if m > 1 else F.lit(sizes[0])
    at = F.floor(F.col("_k") / m).cast("int") + 1 if m > 1 else F.col("_k") + 1
    inside = (F.col("_k") >= 0) & (at + size - 1 <= F.col("n_words"))
    small = (found["bytes"] or 0) <= BROADCAST_BYTES
    cut = F.slice("_w", F.greatest(at, F.lit(1)), size)
    # rows that are shuffled carry their own window only, never the document's words; a
    # document's base row takes a key of its own, as nulls would all meet in one task
    placed = spread.select(
        *names, "n_words", F.when(inside, at).alias("_p"), size.alias("_size"), "_k",
        F.when(inside, F.xxhash64(cut)).otherwise(F.xxhash64(*names)).alias("_h"), ("_w" if small else F.when(inside, cut).alias("_w")),
    ).filter((F.col("_k") == -1) | inside)
    joined = placed.join(F.broadcast(windows) if small else windows, F.col("_h") == F.col("h"), "left" if base else "inner")
    own = F.slice("_w", F.col("_p"), F.col("_size")) if small else F.col("_w")
    hit = F.coalesce(F.col("h").isNotNull() & (own == F.col("win")), F.lit(False))
    rows = joined.filter((F.col("_k") == -1) | hit) if base else joined.filter(hit)
    return rows.select(*names, "n_words", F.when(hit, F.col("_p")).alias("p"), F.col("_size").alias("size"), *[c for c in ("items",) if c in windows.columns])


def _covered(found: Column) -> Column:
    """Words inside the union of the (p, size) intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, x: Column) -> Column:
        end = x.p + x.size
        return F.struct(
            F.greatest(s.end, end).alias("end"),
            (s.n + F.greatest(end - F.greatest(s.end, x.p), F.lit(0))).cast("long").alias("n"),
        )

    return F.aggregate(F.array_sort(found), start, add, lambda s: s.n)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    keys = [F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")]
    rows = _hits(docs, benchmark_windows(benchmark, window), keys, base=True)
    hit = F.when(F.col("p").isNotNull(), F.struct("p", "size", "items"))
    grouped = rows.groupBy("_k0", "_k1", "_k2", "n_words").agg(
        F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("copies"), F.collect_set(hit).alias("found")
    )
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x.items))).cast("array<string>"))
    return (
        grouped.withColumn("ids", ids)
        .withColumn("n_hit", _covered(F.col("found")))
        .select(
            F.col("_k0").alias("doc_id"),
            F.col("n_words").cast("long").alias("n_words"),
            "n_hit",
            F.size("ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"),
        )
        .drop("_copy")
    )


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, p, size, items): each window found, at word p (from 1)."""
    found = _hits(docs, benchmark_windows(benchmark, window), [F.col("doc_id")], base=False)
    return found.select(F.col("_k0").alias("doc_id"), "p", "size", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold any window; columns unchanged."""
    keys = [F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")]
    bad = _hits(docs, benchmark_windows(benchmark, window).drop("items"), keys, base=False).select("_k0", "_k1", "_k2").distinct()
    own = F.col("d.doc_id").eqNullSafe(F.col("b._k0"))
    same = own & (F.xxhash64("d.text") == F.col("b._k1")) & (F.octet_length("d.text") == F.col("b._k2"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
