"""Hard negatives of embeddings by a full score sort for each anchor.

Components are whole numbers, floor(256 * c), and a score is an integer inner product. The
rows are dealt into blocks; every anchor visits every block, twice. First the block's scores
are sorted (falling, ties by vec_id) and the first rows of the anchor's label are its nearest
of the block, which merge into its positives. Then, in the same order, a binary search finds
where scores fall to each positive's, and the first rows of other labels from there on, down
to the lower limit, are read; those of all blocks merge into the positive's negatives. A task
holds one block and a few million scores at a time; neither anchors nor rows meet in one task,
and what leaves a block for an anchor does not grow with the rows.

Rows: a null label, a null vector, or one with a null or non-finite entry takes no part, nor
does a row without vec_id, as nothing could name it. Rows of the anchor's own vec_id are not
"other" rows; repeated rows are candidates each, and a repeated anchor is mined for each of its
rows. Shorter vectors count as padded with zeros. Scores beyond a long are its ends. An
anchor without positives, or a positive without negatives, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, partitions
from tessella.llm.whitening import finite, matrix, whole

POSITIVES = 5
NEGATIVES = 5
#: Lower limit of a negative's score, in hundredths of the positive's.
LOWEST = 80
#: Bytes of a block's matrix, and scores held at once.
BLOCK_BYTES, SCORES = 32 << 20, 1 << 22

_TOP = (1 << 63) - 1
_NEAREST = "a long, vec_id long, score long"
_FOUND = "a long, j int, vec_id long, score long"


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of int64 rows; those beyond a long are its ends."""
    largest = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    bound = largest(anchors) * largest(rows) * anchors.shape[1]
    if bound < 1 << 53:  # every partial sum is a whole double
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound <= _TOP:
        return anchors @ rows.T
    return np.clip(anchors.astype(object) @ rows.astype(object).T, -_TOP, _TOP).astype(np.int64)


class _Block:
    """The rows of a block: ids, labels, matrix."""

    def __init__(self, batches: list[pa.RecordBatch], width: int) -> None:
        self.ids, self.labels = (np.concatenate([b[c].to_numpy() for b in batches]) for c in ("vec_id", "label"))
        self.x = np.concatenate([matrix(b["x"], width) for b in batches])

    def sorted_for(self, batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of ``batch``, positions of the block in falling order of score, those scores)."""
        own = matrix(batch["x"], width)
        step = max(1, SCORES // len(self.ids))
        for at in range(0, len(own), step):
            for k, line in enumerate(scores(own[at : at + step], self.x), at):
                order = np.lexsort((self.ids, -line))
                yield k, order, line[order]


def _over_blocks(width: int, names: list[str], visit):
    """Over rows sorted by (block, kind), rows of a block (kind 0) and then its anchors (kind
    1): what ``visit`` (block, batch of anchors) makes, as batches of longs and ints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            cut = np.flatnonzero(np.diff(batch["block"].to_numpy() * 2 + batch["kind"].to_numpy())) + 1
            for at, to in zip([0, *cut], [*cut, batch.num_rows]):
                some = batch.slice(at, to - at)
                if not some.num_rows:
                    continue
                if some["block"][0].as_py() != number:
                    number, held, block = some["block"][0].as_py(), [], None
                if some["kind"][0].as_py() == 0:
                    held.append(some)
                    continue
                if block is None and held:
                    block, held = _Block(held, width), []
                if block is not None:
                    made = visit(block, some)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "j" else pa.int64()) for n, c in zip(names, made)], names=names)

    return run


def nearest(width: int, count: int):
    """The first ``count`` other rows of an anchor's label in each block: (a, vec_id, score)."""

    def visit(block: _Block, batch: pa.RecordBatch) -> list[np.ndarray]:
        a, ids, labels = (batch[c].to_numpy() for c in ("a", "vec_id", "label"))
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        for k, order, falling in block.sorted_for(batch, width):
            first = np.flatnonzero((block.labels[order] == labels[k]) & (block.ids[order] != ids[k]))[:count]
            for c, x in zip(out, (np.full(len(first), a[k]), block.ids[order[first]], falling[first])):
                c.append(x)
        return [np.concatenate(c) for c in out]

    return _over_blocks(width, ["a", "vec_id", "score"], visit)


def below(width: int, count: int, lowest: int):
    """For each positive of an anchor (``limits``, their scores), the first ``count`` rows of
    other labels of each block from its score down to its lower limit: (a, j, vec_id, score)."""

    def visit(block: _Block, batch: pa.RecordBatch) -> list[np.ndarray]:
        a, labels = (batch[c].to_numpy() for c in ("a", "label"))
        limits = batch["limits"].to_pylist()
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for k, order, falling in block.sorted_for(batch, width):
            other = np.flatnonzero(block.labels[order] != labels[k])
            down = -falling[other]
            for j, score in enumerate(limits[k]):
                low = -(-lowest * score // 100)  # the least whole score with 100 * it >= lowest * score
                if low > score:
                    continue
                start, end = np.searchsorted(down, -score, "left"), np.searchsorted(down, -low, "right")
                found = other[start : min(end, start + count)]
                for c, x in zip(out, (np.full(len(found), a[k]), np.full(len(found), j), block.ids[order[found]], falling[found])):
                    c.append(x)
        return [np.concatenate(c) for c in out]

    return _over_blocks(width, ["a", "j", "vec_id", "score"], visit)


def _first(found: DataFrame, count: int, *keys: str) -> DataFrame:
    """The first ``count`` of each key by falling score, then vec_id, with their ``rank``."""
    within = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= count)


def moved_label(vec_id: Column, label: Column) -> Column:
    """The label, one on (of ten) where vec_id is divisible by 7."""
    own = label.cast("long")
    return F.when(vec_id % 7 == 0, (own + 1) % 10).otherwise(own)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST) -> DataFrame:
    """``rows`` (vec_id, label, embedding, ...) → (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score): for every row with ``is_anchor`` (a condition over ``rows``) and
    each of its first ``positives`` rows of the same label, the first ``negatives`` of other
    labels whose score is at most the positive's and at least ``lowest`` hundredths of it."""
    spark = rows.sparkSession
    vector = F.col("embedding")
    used = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(vector))
    used = used.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(vector).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    used = materialise(used.withColumn("a", F.monotonically_increasing_id()))
    count, width = used.agg(F.count("*"), F.max(F.size("x"))).first()
    width = max(width or 0, 1)
    blocks = max(2 * partitions(spark), -(-count * width * 8 // BLOCK_BYTES))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    home = used.select(F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "a", "vec_id", "label", "x")
    anchors = used.filter("is_anchor")

    def visited(who: DataFrame, *more: str) -> DataFrame:
        guests = who.select(every.alias("block"), F.lit(1).alias("kind"), "a", "vec_id", "label", "x", *more)
        both = home.unionByName(guests, allowMissingColumns=True)
        return both.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    near = materialise(visited(anchors).mapInArrow(nearest(width, positives), _NEAREST))
    ranked = _first(near, positives, "a").select("a", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ranked = materialise(ranked)
    limits = ranked.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("j", "positive_score"))).alias("p")).select("a", F.col("p.positive_score").alias("limits"))
    found = materialise(visited(anchors.join(limits, "a"), "limits").mapInArrow(below(width, negatives, lowest), _FOUND))
    best = _first(found, negatives, "a", "j").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    named = best.join(ranked, ["a", "j"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
