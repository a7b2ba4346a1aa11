"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A document longer than a bin is cut into full pieces and a rest. Pieces are dealt by
hash into shards of about ``SHARD`` pieces, each packed on its own, so that no task
sees more whatever the input; which pieces share a shard depends on the rows and the
number of shards alone. Rows that are alike in everything are counted first and dealt
copy by copy, so no repeated or null id meets in one shard. Within a shard pieces come
largest first. Open bins stand in order of what they have left; each carries a bitmap of
the sources and one of the duplicate clusters inside. For a piece the search starts at
the first bin with room and goes on to its successors until one holds neither the piece's
source nor its cluster: the tightest compatible bin. If none does, a bin is opened.

Rows: a null or negative size counts as 0, and such pieces are packed as well; a null
source or cluster conflicts with nothing; repeated rows are packed one by one; a null
doc_id is an id like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import simhash, tokens
from tessella.llm.common import materialise, materialise_texts

CAPACITY = 2048
SHARD = 4096
#: Copies of one row that a task deals at most.
COPIES = 1 << 20

_OUT = "doc_id long, piece long, start long, size long, bin string, bin_used long, bin_pieces long"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def best_fit(items: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """``items`` (size, source, cluster), in the order in which they are placed → the
    number of each one's bin."""
    items = list(items)
    times = Counter(c for _, _, c in items if c is not None)
    source_bits: dict[object, int] = {}
    cluster_bits: dict[object, int] = {}
    ranked: list[tuple[int, int]] = []  # (left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
        c = 0 if times.get(cluster, 0) < 2 else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(ranked, (size, -1))
        while at < len(ranked) and (sources[ranked[at][1]] & s or clusters[ranked[at][1]] & c):
            at += 1
        if at < len(ranked):
            left, number = ranked.pop(at)
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= s
        clusters[number] |= c
        insort(ranked, (left - size, number))
        out.append(number)
    return out


def _dealt(sized: DataFrame, capacity: int, shard: int) -> DataFrame:
    """(doc_id, piece, start, size, source, cluster, shard): cuts at multiples of ``capacity``."""
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    own = [F.col("doc_id").cast("long").alias("doc_id"), size.alias("whole"), F.col("source"), F.col("cluster")]
    alike = materialise(sized.select(*own).groupBy("doc_id", "whole", "source", "cluster").agg(F.count("*").alias("copies")))
    count = F.greatest(F.ceil(F.col("whole") / capacity), F.lit(1))
    total, most = alike.agg(F.sum(F.col("copies") * count), F.max("copies")).first()
    first = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    some = alike.withColumn("from", F.explode(first))
    if (most or 0) > COPIES:
        some = some.repartition("doc_id", "whole", "source", "cluster", "from")
    last = F.least(F.col("from") + COPIES, F.col("copies")) - 1
    cut = some.withColumn("copy", F.explode(F.sequence(F.col("from"), last))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("piece") * capacity
    key = F.xxhash64("doc_id", "piece", "whole", "source", "cluster", "copy")
    return cut.select(
        "doc_id", "piece", start.alias("start"), F.least(F.col("whole") - start, F.lit(capacity)).alias("size"), "source", "cluster",
        F.pmod(key, F.lit(max(1, -(-(total or 0) // shard)))).alias("shard"),
    )


def _order(row: tuple) -> tuple:
    doc_id, piece, _, size, source, cluster, _ = row
    nulls = lambda x: (x is not None, 0 if x is None else x)
    return (-size, nulls(doc_id), piece, nulls(source), nulls(cluster))


def pack(sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, conflicts: bool = False) -> DataFrame:
    """``sized`` (doc_id, size, source, cluster) → one row per piece, with its bin, what
    the bin holds in all and of how many pieces; with ``conflicts`` its source and cluster too."""
    carried = ["source", "cluster"] if conflicts else []
    types = {f.name: f.dataType for f in sized.schema.fields}
    schema = ", ".join([_OUT, *(f"{c} {types[c].simpleString()}" for c in carried)])

    def one(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(c.to_pylist() for c in group.columns)), key=_order)
        number = best_fit(((r[3], r[4], r[5]) for r in rows), capacity)
        used, held = Counter(), Counter(number)
        for r, n in zip(rows, number):
            used[n] += r[3]
        made = [
            *([r[k] for r in rows] for k in range(4)),
            [f"{r[6]}-{n}" for r, n in zip(rows, number)], [used[n] for n in number], [held[n] for n in number],
        ]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64()]
        for c in carried:
            made.append([r[4 + carried.index(c)] for r in rows])
            kinds.append(group.schema.field(c).type)
        return pa.table([pa.array(c, t) for c, t in zip(made, kinds)], names=[*(f.split()[0] for f in _OUT.split(", ")), *carried])

    return _dealt(sized, capacity, shard).groupBy("shard").applyInArrow(one, schema)


def audit(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pack`` with their conflicts → of each source its pieces and their size, and how
    many of the pieces are in a bin without another of their source, without another of their
    cluster, and in a bin that holds what it says and no more than it can. A null source or
    cluster is never in the way of another."""
    whole = Window.partitionBy("bin")
    alone = lambda k: F.col(k).isNull() | (F.count("*").over(Window.partitionBy("bin", k)) == 1)
    held, n = F.sum("size").over(whole), F.count("*").over(whole)
    fits = (held <= capacity) & (held == F.col("bin_used")) & (n == F.col("bin_pieces"))
    judged = packed.select("source", "size", alone("source").alias("apart_by_source"), alone("cluster").alias("apart_by_cluster"), fits.alias("fitting"))
    right = [F.count_if(k).alias(k) for k in ("apart_by_source", "apart_by_cluster", "fitting")]
    return judged.groupBy("source").agg(F.count("*").alias("pieces"), F.sum("size").alias("words"), *right)


def sized_by_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size in words, source, cluster) of ``documents``; equal texts are a cluster."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("cluster"))


def sized_by_tokens(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, shingle: int = 5) -> DataFrame:
    """(doc_id, size in tokens, source, cluster) of ``documents``, clusters being those of
    SimHash fingerprints within ``simhash.RADIUS`` bits. Texts are read once."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), tokens.token_count(F.coalesce(text, F.lit("")), vocabulary).alias("size"), "source",
        simhash.fingerprint_column(text, shingle).alias("fp"),
    )
    rows = materialise_texts(rows)
    named = materialise(simhash.classes(rows).withColumnRenamed("root", "cluster"))
    return rows.join(named, "fp").select("doc_id", "size", "source", "cluster")
