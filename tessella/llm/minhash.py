"""MinHash document fingerprints.

A text's words are split at ASCII white space after lower-casing A-Z; its shingles
are runs of ``SHINGLE`` words (fewer words: the whole sequence; none: no shingle).
Each shingle hashes to 32 bits, each of ``PERMUTATIONS`` maps x -> a*x + b mod 2^32
(a odd, so a bijection) reorders the hashes, and the signature keeps the low 16 bits
of each least value. Two signatures agree in a position with the probability of the
sets' Jaccard similarity, but for a chance of 2^-16.

Rows: null text counts as empty; two texts without words are alike (1.0), one without
words is unlike any other (0.0); repeated rows keep a row each and follow each other;
a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, materialise_texts, with_successors
from tessella.llm.components import connected_components
from tessella.llm.sketches import WIDTH, block_links, run_pairs

SHINGLE = 5
PERMUTATIONS = 128
SEED = 20_240_501
_BLOCK = 8192  # shingles permuted at a time, 4 MB with 128 permutations
_EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)


@lru_cache
def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
    return a[:, None], b[:, None]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """32-bit hashes of all word n-shingles, block by block."""
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh32_intdigest
    n = min(n, len(words))
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    total = len(words) - n + 1
    for at in range(0, total, _BLOCK):
        to = min(total, at + _BLOCK)
        yield np.array(
            [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + n - 1 : to + n - 1])],
            np.uint32,
        )


def signature(text: str, n: int = SHINGLE, count: int = PERMUTATIONS) -> np.ndarray | None:
    """uint16[count]; None for a text without words."""
    a, b = _family(count)
    least = None
    for hashes in shingle_hashes(words_of(text), n):
        low = (a * hashes + b).min(axis=1)
        least = low if least is None else np.minimum(least, low)
    return None if least is None else least.astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def as_text(sig: np.ndarray | None) -> str:
    """Hex digits, four a permutation; a text without words has all ones."""
    return (_EMPTY if sig is None else sig).astype(">u2").tobytes().hex()


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of
    ``following``, or all of it if that is shorter."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_bucket, _ahead, _key); one row is held until its successor comes."""
    pending = None
    bucket, done = None, False
    names = [part.split()[0] for part in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_bucket", "_ahead", "doc_id", "text")]
        for i in range(batch.num_rows):
            at, ahead, doc_id, text = (c[i].as_py() for c in columns)
            if at != bucket:
                if pending is not None:
                    raise RuntimeError("a bucket came without the row after it")
                bucket, done = at, False
            if done:
                continue
            text = text or ""
            sig = signature(text)
            if pending is not None:
                p_id, p_text, p_sig = pending
                edited = half_replaced(p_text, text)
                edited_sig = signature(edited)
                rows.append((
                    p_id, len(p_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    as_text(p_sig), as_text(edited_sig), likeness(p_sig, edited_sig), likeness(p_sig, sig),
                ))
            pending = None if ahead else (doc_id, text, sig)
            done = ahead
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    if pending is not None:
        raise RuntimeError("the last bucket came without the row after it")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its half-replaced text (with the next document's
    start, by ascending id; after the last comes the first) and compares signatures.
    Texts are shuffled once, into id ranges."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ordered = with_successors(slim, key, ["text"], wrap=True, size=F.octet_length("text"))
    return ordered.select("_bucket", "_ahead", "doc_id", "text").mapInArrow(_compare, _OUT)


# -- near duplicates by banding --------------------------------------------------------

SIMILARITY = 0.8
BANDS = PERMUTATIONS // WIDTH  # a pair at 0.8 meets in some band but for 5e-8
#: Below the similarity, in estimates, from which pairs are counted exactly: seven standard errors.
MARGIN = 0.25
#: Rows of a run up to which its pairs are sent to be counted, and rows of a part of a longer one.
PAIRS_UP_TO, BLOCK = 64, 512
#: Rows whose sets are wanted up to which they are broadcast, so that no text is shuffled.
BROADCAST_ROWS = 1_000_000


def _set(words: list[bytes], shingle: int) -> np.ndarray:
    parts = [*shingle_hashes(words, shingle)]
    return np.unique(np.concatenate(parts)).view(np.int32) if parts else np.empty(0, np.int32)


def _prints(shingle: int, fingerprint: Callable[[str], int] | None):
    """Over rows (..., text): the columns before the text, signature, node and size of the set,
    the bits of the text's 64-bit fingerprint by the function given, and how many words it has."""
    a, b = _family(PERMUTATIONS)

    def of(text: str) -> tuple[bytes, int, int, int, int]:
        words = words_of(text)
        own = _set(words, shingle)
        least = _EMPTY if len(own) else None
        for at in range(0, len(own), _BLOCK):
            low = (a * own[at : at + _BLOCK].view(np.uint32) + b).min(axis=1)
            least = low if at == 0 else np.minimum(least, low)
        sig = _EMPTY if least is None else least.astype(np.uint16)
        fp = 0 if fingerprint is None else fingerprint(text)
        return sig.tobytes(), xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), len(own), fp - (fp >> 63 << 64), len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(t.as_py() or "") for t in batch.columns[-1]]
            made = [pa.array([x[c] for x in found], t) for c, t in enumerate((pa.binary(), *[pa.int64()] * 4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "signature", "node", "size", "fp", "words"])

    return run


def _sets(shingle: int):
    """Over rows (node, text): node and set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set(words_of(t.as_py() or ""), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return run


def row_key(of: str = "") -> list[Column]:
    """id, h, n: a row's doc_id (null is the largest long), text hash and text length."""
    own, text = F.coalesce(F.col(f"{of}doc_id").cast("long"), F.lit((1 << 63) - 1)), F.col(f"{of}text")
    return [own.alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("n")]


def printed(docs: DataFrame, shingle: int, *more: Column, fingerprint: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prints, nodes): key, ``more``, fp, words, node, signature and size of the set of shingles of
    each row; and of each node, which are the rows of equal sets, with the least row."""
    slim = docs.select(*row_key(), *more, F.col("text").alias("text"))
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    prints = materialise_texts(slim.mapInArrow(_prints(shingle, fingerprint), f"{given}, signature binary, node long, size long, fp long, words long"))
    least = F.min(F.struct("id", "h", "n")).alias("row")
    return prints, materialise(prints.groupBy("node").agg(least, F.first("signature").alias("signature"), F.first("size").alias("size")))


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes wanted, made again from the texts of their rows."""
    rows = materialise(nodes.join(wanted, "node").select("node", "row.*"))
    small = rows.count() <= BROADCAST_ROWS
    slim = docs.select(*row_key(), F.col("text").alias("text"))
    found = slim.join(F.broadcast(rows) if small else rows, ["id", "h", "n"]).select("node", "text")
    return materialise_texts(found.mapInArrow(_sets(shingle), "node long, shingles array<int>").dropDuplicates(["node"]))


def similar_nodes(
    nodes: DataFrame,
    docs: DataFrame,
    shingle: int,
    similarity: float,
    pairs_up_to: int = PAIRS_UP_TO,
    block: int = BLOCK,
    proposed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``nodes`` of ``docs`` → links (u, v) whose components are those of all pairs of that
    Jaccard similarity, and (node, n_links), the number of such pairs.

    Nodes are filed under each band of their signature, and each pair belongs to the first
    band that it shares. Pairs of runs of at most ``pairs_up_to`` are joined with their sets,
    as are ``proposed`` (u, v), which make links only. A longer run is cut into parts of
    about ``block``, and each two parts are a task."""
    band = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BANDS - 1).cast("long")))
    values = F.substring("signature", F.lit(1) + F.col("k").cast("int") * 2 * WIDTH, F.lit(2 * WIDTH))
    key = F.shiftleft(F.xxhash64("k", values), 5) + F.col("k")  # the low five bits tell the band
    filed = nodes.filter("size > 0").select("node", "signature", band.alias("k")).select(key.alias("key"), "node")
    sizes = materialise(filed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    company = materialise(filed.join(sizes, "key").select("key", "m", "node"))
    of_key, least = F.col("key").bitwiseAND(F.lit(BANDS - 1)), similarity - MARGIN
    few = company.filter(F.col("m") <= pairs_up_to).join(nodes.select("node", "signature"), "node").select("key", of_key.alias("k"), "node", "signature")
    met = materialise(few.repartition("key").sortWithinPartitions("key").mapInArrow(run_pairs(least), "u long, v long"))
    pairs = met.withColumn("own", F.lit(True))
    if proposed is not None:
        pairs = pairs.unionByName(materialise(proposed).withColumn("own", F.lit(False)))
    long = company.filter(F.col("m") > pairs_up_to)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(long.select("node")).distinct()
    sets = _sets_of(wanted, nodes, docs, shingle)
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = (F.size("a") + F.size("b") > 0) & (both / (F.size("a") + F.size("b") - both) >= similarity)
    found = materialise(pairs.join(left, "u").join(right, "v").filter(alike).select("u", "v", "own"))
    links = found.select("u", "v")
    ends = found.filter("own").select(F.explode(F.array("u", "v")).alias("node"), F.lit(1).cast("long").alias("times"))
    if not long.isEmpty():
        parts = F.ceil(F.col("m") / block).cast("int")
        dealt = long.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.select("key", of_key.alias("k"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node")
        order = ["key", "k", "i", "j"]
        rows = dealt.join(nodes.select("node", "signature").join(sets, "node"), "node").select(*order, "part", "node", "signature", "shingles")
        found = materialise(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(block_links(least, similarity), "u long, v long, n long"))
        links = links.unionByName(found.filter("v IS NOT NULL").select("u", "v"))
        ends = ends.unionByName(found.filter("v IS NULL").select(F.col("u").alias("node"), F.col("n").alias("times")))
    return links, ends.groupBy("node").agg(F.sum("times").alias("n_links"))


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all ``nodes``: the smallest node reachable over links."""
    roots = connected_components(links).withColumnRenamed("u", "node")
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def clusters(docs: DataFrame, *more: Column, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``more`` columns of every row of ``docs``, the number of its words (``words``) and
    ``cluster``, a long that rows share if they are linked, over any number of documents, at
    that Jaccard similarity."""
    prints, nodes = printed(docs, shingle, *more)
    links, _ = similar_nodes(nodes, docs, shingle, similarity)
    kept = [*prints.columns[3 : 3 + len(more)], "words"]
    # both sides are shuffled for this join alone, so that a hot class can be split
    named = materialise(rooted(nodes, links).withColumnRenamed("root", "cluster"))
    return prints.select("node", *kept).join(named, "node").select(*kept, "cluster")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, pairs_up_to: int = PAIRS_UP_TO, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id, n_links), a row for each input row: documents linked at a
    Jaccard similarity of ``similarity`` or more, the smallest id of those reachable, and
    the number of links of the document's class of equal shingle sets.

    Every link is counted over the two shingle sets (``similar_nodes``).
    Rows of null doc_id form classes like others but name none; texts without words are
    one class."""
    prints, nodes = printed(docs, shingle, F.col("doc_id").cast("long").alias("doc_id"))
    links, ends = similar_nodes(nodes, docs, shingle, similarity, pairs_up_to, block)
    firsts = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    classes = materialise(firsts.join(rooted(nodes, links), "node"))
    ids = materialise(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = classes.join(ids, "root").join(ends, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id", "n_links")
