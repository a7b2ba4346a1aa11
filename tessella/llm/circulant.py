"""MinHash near-duplicates with circulant signatures.

A document's set holds the 64-bit hashes of its distinct word shingles (``shingles``). Two
permutations of ``UNIVERSE`` positions make the whole signature: the first sends a shingle to
a position p, the second, circularly shifted by k, gives coordinate k the least value at p + k
over the set. So a shingle's coordinates are one window of a table, and a signature is the
element-wise least of windows.

Rows of equal sets are one node. Nodes that share a band of ``WIDTH`` coordinates may be near;
a pair at 0.8 shares none of the ``BANDS`` once in 2e7. A run, the nodes of one band value, of
up to ``PAIRS_UP_TO`` gives its own pairs. A longer one gives a star: each member with the
run's hub, the member that shares the most over all runs, so its pairs grow with its members.
Members that are not linked with the hub are compared with all others in blocks; runs with the
same hub are one where that asks for no more comparisons. Every link is
counted over both sets of shingles; components are those of all links.

Rows: null text is empty. A text with fewer words than a shingle is one shingle. A document
without words is linked with nothing and is its own component. Rows that repeat a doc_id are
rows of their own; a null doc_id names no component unless all of it are null, and is kept
where it equals its component_id, null being equal to null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, materialise_texts
from tessella.llm.components import connected_components
from tessella.llm.minhash import row_key
from tessella.llm.shingles import shingle_set
from tessella.llm.sketches import WIDTH, owned, run_pairs, similar

SHINGLE = 4
PERCENT = 80
UNIVERSE = 1 << 20
COORDINATES = 128
BANDS = COORDINATES // WIDTH
SEED = 20_250_301
#: Below the similarity, in estimates, from which pairs are counted: over five standard errors.
MARGIN = 0.2
#: Nodes of a run up to which its pairs are all proposed, and of a block of a longer one.
PAIRS_UP_TO, BLOCK = 32, 512
#: Hashes in the sets of a block's members.
BLOCK_HASHES = 1 << 21
#: Rows whose sets are wanted up to which they are broadcast, so that no text is shuffled.
BROADCAST_ROWS = 1_000_000
_AT_ONCE = 4096  # windows, 2 MB


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the windows of the second: row p has its values at p, p + 1, ..."""
    rng = np.random.default_rng(SEED)
    first, second = (rng.permutation(UNIVERSE).astype(np.uint32) for _ in range(2))
    around = np.concatenate([second, second[: COORDINATES - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(around, COORDINATES)


def signature(own: np.ndarray) -> np.ndarray:
    """uint16[COORDINATES] of a set of hashes, the low bits of the least values; all ones for none."""
    first, windows = _tables()
    places = first[(own & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), _AT_ONCE):
        np.minimum(least, windows[places[at : at + _AT_ONCE]].min(axis=0), out=least)
    return least.astype(np.uint16)


def _texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _prints(shingle: int):
    """Over rows (..., text): the columns before the text, signature, node and size of the set."""

    def of(text: bytes) -> tuple[bytes, int, int]:
        own = shingle_set(text, shingle)
        return signature(own).tobytes(), xxhash.xxh64_intdigest(own, SEED) - (1 << 63), len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(t) for t in _texts(batch.columns[-1])]
            made = [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "signature", "node", "size"])

    return run


def _sets(shingle: int):
    """Over rows (node, text): node and set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), _texts(batch.column(1))):
                own = pa.array(shingle_set(text, shingle).view(np.int64))
                held = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), held], names=["node", "shingles"])

    return run


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes wanted, made again from the texts of their least rows."""
    rows = materialise(nodes.join(wanted.distinct(), "node").select("node", "row.*"))
    small = rows.count() <= BROADCAST_ROWS
    slim = docs.select(*row_key(), F.col("text").alias("text"))
    found = slim.join(F.broadcast(rows) if small else rows, ["id", "h", "n"]).select("node", "text")
    return materialise_texts(found.mapInArrow(_sets(shingle), "node long, shingles array<long>").dropDuplicates(["node"]))


def _alike(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("long")
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are alike."""
    right = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = right.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return materialise(both.filter(_alike(F.col("a"), F.col("b"), percent)).select("u", "v"))


def block_links(least: float, similarity: float):
    """Over rows (run, band, i, j, left, node, root, signature, set) sorted by the first four: the
    pairs of a left and another row whose roots differ, counted over their sets; with a band,
    those that first agree there. As links (u, v) a spanning forest of the roots."""

    def near(x: np.ndarray, y: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
        if band >= 0:
            return owned(x, y, band, least)
        found = [np.flatnonzero((y == one).sum(axis=1) >= least * x.shape[1]) for one in x]
        return np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate(found)

    def flush(band: int, rows: list[tuple]) -> pa.RecordBatch | None:
        left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not left or not right:
            return None
        x, y = (np.frombuffer(b"".join(r[3] for r in side), np.uint16).reshape(len(side), -1) for side in (left, right))
        i, j = near(x, y, band)
        (p, rp), (q, rq) = ((np.array([r[1] for r in side], np.int64), np.array([r[2] for r in side], np.int64)) for side in (left, right))
        apart = rp[i] != rq[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return None
        alike = similar(i, j, [r[4].values.to_numpy() for r in left], [r[4].values.to_numpy() for r in right], similarity)
        ids, ends = np.unique(np.concatenate([rp[i[alike]], rq[j[alike]]]), return_inverse=True)
        u, v = np.split(ends, 2)
        label = np.arange(len(ids))
        while True:
            new, low = label.copy(), np.minimum(label[u], label[v])
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows = None, []
        for batch in batches:
            columns = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for r in zip(*columns):
                if r[:4] != head:
                    if rows and (made := flush(head[1], rows)):
                        yield made
                    head, rows = r[:4], []
                rows.append(r[4:])
        if rows and (made := flush(head[1], rows)):
            yield made

    return run


def _apart(long: DataFrame, hubs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, band, node, size, root, outside): members of the runs ``long`` (key, node) that their
    hub's star has not made one: outside, and their own root, are those that are not linked with
    the hub. Runs of one hub are put together, without a band, where members outside times
    members is no more then."""
    linked = found.select(F.explode(F.array(F.struct(F.col("u").alias("hub"), F.col("v").alias("node")), F.struct(F.col("v").alias("hub"), F.col("u").alias("node")))).alias("l"))
    linked = linked.select("l.*", F.lit(True).alias("near"))
    placed = long.select("key", "node").join(hubs, "key").join(linked, ["hub", "node"], "left").withColumn("outside", F.col("near").isNull() & (F.col("node") != F.col("hub")))
    placed = materialise(placed.select("key", "hub", "node", "outside"))
    few, joint = F.count_if("outside"), F.col("whole") <= F.col("work")
    work = placed.groupBy("key", "hub").agg(few.alias("few"), (few * F.count("*")).cast("double").alias("work")).filter("few > 0")
    whole = placed.select("hub", "node", "outside").distinct().groupBy("hub").agg((few * F.count("*")).cast("double").alias("whole"))
    joined = materialise(work.groupBy("hub").agg(F.sum("work").alias("work")).join(whole, "hub").select("hub", joint.alias("joint")))
    open_ = materialise(work.join(joined, "hub").select("key", F.when(F.col("joint"), F.col("hub")).otherwise(F.col("key")).alias("run"), F.when(F.col("joint"), -1).otherwise(F.col("key").bitwiseAND(F.lit(BANDS - 1))).alias("band")))
    rows = placed.join(open_, "key").select("run", "band", "node", F.when(F.col("outside"), F.col("node")).otherwise(F.col("hub")).alias("root"), "outside").distinct()
    return materialise(rows.join(nodes.select("node", "size"), "node"))


def _left_apart(rows: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """Links (u, v) within the runs of ``rows`` (``_apart``): members outside, in blocks of ``block``,
    are compared with all of the run, in blocks of four times as many."""
    count = lambda what, held, size: F.greatest(F.ceil(held / what), F.ceil(size / BLOCK_HASHES)).cast("int")
    few = lambda x: F.sum(F.when(F.col("outside"), x).otherwise(0))
    sizes = rows.groupBy("run", "band").agg(count(block, few(1), few(F.col("size"))).alias("is"), count(4 * block, F.count("*"), F.sum("size")).alias("js"))
    cut = rows.join(materialise(sizes), ["run", "band"])
    part = lambda of: F.pmod(F.xxhash64("node", F.lit(1)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = cut.filter("outside").withColumns({"i": part("is"), "left": F.lit(True)}).withColumn("j", every("js"))
    right = cut.withColumns({"j": part("js"), "left": F.lit(False)}).withColumn("i", every("is"))
    order = ["run", "band", "i", "j"]
    dealt = left.unionByName(right).select(*order, "left", "node", "root")
    sets = _sets_of(rows.select("node"), nodes, docs, shingle)
    full = dealt.join(nodes.select("node", "signature").join(sets, "node"), "node").select(*order, "left", "node", "root", "signature", "shingles")
    return materialise(full.repartition(*order).sortWithinPartitions(*order).mapInArrow(block_links(percent / 100 - MARGIN, percent / 100), "u long, v long"))


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the smallest node reachable from each."""
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, pairs_up_to: int = PAIRS_UP_TO, block: int = BLOCK) -> DataFrame:
    """``nodes`` (node, row, signature, size) of ``docs`` → links (u, v) whose components are
    those of all pairs with 100 * intersection >= percent * union."""
    band = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BANDS - 1).cast("long")))
    values = F.substring("signature", F.lit(1) + F.col("k").cast("int") * 2 * WIDTH, F.lit(2 * WIDTH))
    key = F.shiftleft(F.xxhash64("k", values), 5) + F.col("k")  # the low five bits tell the band
    filed = nodes.filter("size > 0").select("node", "signature", band.alias("k")).select(key.alias("key"), "node")
    # written out, so that the join below shuffles both sides for itself and a long run is split
    runs = materialise(filed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    company = materialise(filed.join(runs, "key").select("key", "m", "node"))
    few = company.filter(F.col("m") <= pairs_up_to).join(nodes.select("node", "signature"), "node")
    few = few.select("key", F.col("key").bitwiseAND(F.lit(BANDS - 1)).alias("k"), "node", "signature")
    pairs = few.repartition("key").sortWithinPartitions("key").mapInArrow(run_pairs(percent / 100 - MARGIN), "u long, v long")
    long = company.filter(F.col("m") > pairs_up_to)
    star = lambda rows: rows.filter("node <> hub").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v"))
    alike = lambda pairs: _counted(pairs, _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), nodes, docs, shingle), percent)
    if long.isEmpty():
        return alike(materialise(pairs.distinct()))
    weight = materialise(long.groupBy("node").agg(F.sum("m").alias("weight")))
    hub = F.max_by("node", F.struct("weight", F.xxhash64("node"))).alias("hub")
    hubs = materialise(long.select("key", "node").join(weight, "node").groupBy("key").agg(hub))
    found = alike(materialise(pairs.unionByName(star(long.join(hubs, "key"))).distinct()))
    apart = _apart(long, hubs, found, nodes)
    return found if apart.isEmpty() else found.unionByName(_left_apart(apart, nodes, docs, shingle, percent, block))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, pairs_up_to: int = PAIRS_UP_TO, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each input row of (doc_id, text, ...)."""
    slim = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = materialise_texts(slim.mapInArrow(_prints(shingle), "id long, h long, n int, doc_id long, signature binary, node long, size long"))
    least = F.min(F.struct("id", "h", "n")).alias("row")
    nodes = materialise(prints.groupBy("node").agg(least, F.first("signature").alias("signature"), F.first("size").alias("size"), F.min("doc_id").alias("first_id")))
    roots = connected_components(links(nodes, docs, shingle, percent, pairs_up_to, block))
    classes = materialise(nodes.select("node", "first_id").join(_with_roots(nodes.select("node"), roots), "node"))
    ids = materialise(classes.groupBy("root").agg(F.min("first_id").alias("named")))
    named = materialise(classes.join(ids, "root").select("node", "named"))
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("named"))
    rows = prints.select("doc_id", "size", "node").join(named, "node").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
