"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles. Fingerprints link at up to ``RADIUS`` differing bits. The 64 bits are
two segments of 32: two linked fingerprints differ in at most 2 bits of the upper
segment, or else in at most 1 of the lower. So for the upper segment every
fingerprint is filed under the 33 values within one bit of its own (two values
within 2 bits meet at the one between them), and for the lower under its own value
and those that set one more bit (of two values one bit apart, one sets the bit).
Whatever shares a file is compared over all 64 bits.

Only distinct fingerprints are filed, so exact copies cost one entry. A file is
read as a sorted run and answers with the links of a spanning forest, never with
all pairs. Runs beyond ``RUN_LIMIT`` entries are not compared pairwise at all: their
members are filed once more under all values within half the radius, rounded up, of the
whole fingerprint, and linked there to the smallest of those within half the radius,
rounded down: one star a file. That is exact as well, and linear in the members.

Rows: null text counts as empty, empty text (no words) has fingerprint zero and is
linked like any other; repeated rows each keep their row; a null doc_id never names
a component unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import minhash
from tessella.llm.common import materialise, materialise_texts, partitions
from tessella.llm.components import connected_components

RADIUS = 4
SEED = 42
RUN_LIMIT = 4096
_BLOCK = 100_000  # shingles hashed at a time
_MASK = (1 << 64) - 1


def simhash(text: str | None, n: int) -> int:
    """Unsigned 64-bit fingerprint of word ``n``-shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    total, counts, digest = len(words) - n + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, _BLOCK):
        to = min(total, at + _BLOCK)
        hashes = np.array(
            [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + n - 1 : to + n - 1])],
            dtype=">u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprint_column(text: Column, n: int) -> Column:
    """Signed long with the fingerprint's bits."""

    @F.pandas_udf(T.LongType())
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(np.array([simhash(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def _files() -> Column:
    """(segment, bit) pairs as an array: bit 0 is the value itself."""
    bits = [0, *(1 << k for k in range(32))]
    rows = [F.struct(F.lit(s).cast("long").alias("s"), F.lit(b).cast("long").alias("b")) for s in (0, 1) for b in bits]
    return F.array(*rows)


def _filed(distinct: DataFrame) -> DataFrame:
    """(key, fp): the key's bit 32 tells the segment."""
    value = F.when(F.col("f.s") == 0, F.shiftrightunsigned("fp", 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return (
        distinct.select("fp", F.explode(_files()).alias("f"))
        .select("fp", "f", value.alias("v"))
        .filter((F.col("f.s") == 0) | (F.col("v").bitwiseAND(F.col("f.b")) == 0))
        .select((F.col("v").bitwiseXOR(F.col("f.b")) + F.shiftleft(F.col("f.s"), 32)).alias("key"), "fp")
    )


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller-index value) that span each group of ``values`` connected
    at up to ``radius`` bits; compared in blocks, so memory is linear in the run."""
    n = len(values)
    label = np.arange(n)
    block = max(1, (1 << 18) // n)  # a few MB at a time
    while True:
        new = label.copy()
        for at in range(0, n, block):
            near = np.bitwise_count(values[at : at + block, None] ^ values[None, :]) <= radius
            new[at : at + block] = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(n)
    return values[moved], values[label[moved]]


def _run_links(radius: int, limit: int):
    """Over rows sorted by key: links found within each run of one key; for runs longer
    than ``limit`` rows (fp, null). Holds one batch and at most ``limit`` rows of a run."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def close(run: list[np.ndarray], over: bool, out_u: list, out_v: list, marks: list) -> None:
        values = np.unique(np.concatenate(run))
        if over:
            marks.append(values)
        elif len(values) > 1:
            u, v = forest(values.view(np.uint64), radius)
            out_u.append(u.view(np.int64))
            out_v.append(v.view(np.int64))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[np.ndarray] = []
        held, over, last = 0, False, None
        out_u: list[np.ndarray] = []
        out_v: list[np.ndarray] = []
        marks: list[np.ndarray] = []

        def flush():
            u = np.concatenate([*out_u, *marks]) if out_u or marks else np.empty(0, np.int64)
            v = np.concatenate(out_v) if out_v else np.empty(0, np.int64)
            column = pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(u) - len(v), pa.int64())])
            out_u.clear(), out_v.clear(), marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), column], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
            if last is not None and keys[0] != last:
                close(run, over, out_u, out_v, marks)
                run, held, over = [], 0, False
            size = ends - starts
            inner = np.arange(len(starts))
            inner = inner[(inner > 0) & (inner < len(starts) - 1)]
            two = inner[size[inner] == 2]  # nearly all runs that have company at all
            a, b = fps[starts[two]], fps[starts[two] + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            out_u.append(a[near])
            out_v.append(b[near])
            for k in inner[size[inner] > 2]:
                close([fps[starts[k] : ends[k]]], size[k] > limit, out_u, out_v, marks)
            for k in sorted({0, len(starts) - 1}):  # may join the batch before or after
                if k and run:
                    close(run, over, out_u, out_v, marks)
                    run, held, over = [], 0, False
                run.append(fps[starts[k] : ends[k]])
                held += size[k]
                if held > limit:  # give up comparing; pass members on as they come
                    over = True
                    close(run, over, out_u, out_v, marks)
                    run = [run[0][:1]]
            last = keys[-1]
            yield flush()
        if run:
            close(run, over, out_u, out_v, marks)
            yield flush()

    return links


def _ball(bits: int) -> list[int]:
    """All 64-bit masks of at most ``bits`` set bits, as signed longs."""
    masks = [sum(1 << k for k in c) for r in range(bits + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """``distinct`` (fp long) → links (u, v) whose connected components are those of
    the graph of all pairs within ``radius`` (at most 4) differing bits."""
    if not 0 <= radius <= 4:
        raise ValueError("the two segments are enough for up to 4 differing bits")
    # few tasks hold the bare fingerprints, and each of them is filed 66 times
    spread = distinct.repartition(partitions(distinct.sparkSession), "fp")
    found = materialise(
        _filed(spread)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_run_links(radius, run_limit), "u long, v long")
    )
    close = found.filter("v IS NOT NULL")
    if found.filter("v IS NULL").isEmpty():
        return close
    hot = found.filter("v IS NULL").select(F.col("u").alias("fp")).distinct()
    reach = lambda bits: hot.select(F.col("fp"), F.explode(F.array(*map(F.lit, _ball(bits)))).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("key"), "fp"
    )
    stars = reach(radius // 2).groupBy("key").agg(F.min("fp").alias("v"))
    met = reach((radius + 1) // 2).join(stars, "key").filter("fp <> v")
    return close.unionByName(met.select(F.col("fp").alias("u"), "v").distinct())


def classes(prints: DataFrame, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(fp, root) of every distinct fingerprint in ``prints``: the smallest one reachable."""
    distinct = materialise(prints.select("fp").distinct())
    roots = connected_components(fingerprint_links(distinct, radius, run_limit))
    return distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """One row per input row: (doc_id, fp long, component_id), where component_id is the
    smallest id among the documents reachable over links."""
    prints = materialise_texts(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    )
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = materialise(firsts.join(classes(prints, radius, run_limit), "fp"))
    # written out, so that the join shuffles both sides and a large group can be split
    ids = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# -- near copies by shingle similarity ------------------------------------------------

#: What ``near_copies`` takes as near: Jaccard similarity of the sets of 5-word shingles.
SIMILARITY = 0.8


def _proposed(prints: DataFrame, radius: int, run_limit: int) -> DataFrame:
    """(u, v): nodes of linked fingerprints, by the first node of each, and each node with the
    first of its own fingerprint."""
    nodes = materialise(prints.select("node", "fp").distinct())
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    met = fingerprint_links(firsts.select("fp"), radius, run_limit)
    named = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_"))
    linked = met.join(named("u"), "u").join(named("v"), "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
    own = nodes.join(firsts, "fp").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return linked.unionByName(own).filter("u <> v").distinct()


def near_copies(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = SIMILARITY,
    group_limit: int = minhash.BLOCK,
    radius: int = RADIUS,
    run_limit: int = RUN_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(prints, kept): id, text hash ``h`` and length ``n`` of every row, and of the smallest
    document of each group of near copies (by id, a null doc_id being the largest long).

    Pairs are proposed by SimHash, over the multi-index of ``fingerprint_links``, and, as
    most pairs at 0.8 lie beyond any radius that small balls reach, by the bands of MinHash
    signatures as well (``minhash.similar_nodes``), which miss a pair at 0.8 once in 2e7. A
    pair is a link if the Jaccard similarity of its two sets of shingles, counted, is at
    least ``similarity``. Runs of a band beyond ``group_limit`` are compared part by part."""
    prints, nodes = minhash.printed(docs, shingle, fingerprint=lambda text: simhash(text, shingle))
    up_to = min(minhash.PAIRS_UP_TO, group_limit)
    links, _ = minhash.similar_nodes(nodes, docs, shingle, similarity, up_to, group_limit, _proposed(prints, radius, run_limit))
    kept = minhash.rooted(nodes, links).join(nodes.select("node", "row"), "node").groupBy("root").agg(F.min("row").alias("row"))
    return prints.select("id", "h", "n"), materialise(kept.select("row.*"))


def _one_each(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """One of the rows that share the keys."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(*[k.alias(n) for k, n in zip(keys, names)], row)
    return rows.groupBy(*names).agg(F.first("row").alias("row")).select("row.*")


def keep_documents(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without all but one row of each group of near copies: one of the smallest
    doc_id stays. Columns are unchanged. Rows are told apart by doc_id and text, so rows of a
    repeated or null doc_id stay if their texts are no near copies."""
    prints, kept = near_copies(docs, shingle, similarity)
    id_, h, n = minhash.row_key("d.")
    same = (id_ == F.col("k.id")) & (h == F.col("k.h")) & (n == F.col("k.n"))
    left = docs.alias("d").join(kept.alias("k"), same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if prints.groupBy("id", "h", "n").count().filter("count > 1").isEmpty():
        return left
    return _one_each(left, minhash.row_key())


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``keep_documents`` where doc_id identifies a document: of what stays, one row of each
    doc_id (null included)."""
    return _one_each(keep_documents(docs, shingle, similarity), [F.col("doc_id")])


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
