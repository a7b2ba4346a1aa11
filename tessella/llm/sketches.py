"""Comparing sketches (equal-length arrays of 16-bit values), and the sets they stand for,
within sorted runs of rows.

A run holds the rows whose sketches agree in one band of ``WIDTH`` values. Two rows may
agree in several bands; the pair belongs to the first of them, so each pair comes once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 4  # values a band, 64 bits


def alike(sketches: np.ndarray, least: float) -> np.ndarray:
    """Boolean matrix of pairs whose sketches agree in at least that share of values."""
    n = len(sketches)
    out = np.zeros((n, n), bool)
    block = max(1, (1 << 24) // (n * sketches.shape[1]))
    need = least * sketches.shape[1]
    for at in range(0, n, block):
        out[at : at + block] = (sketches[at : at + block, None, :] == sketches[None, :, :]).sum(axis=2, dtype=np.int32) >= need
    return out


def owned(left: np.ndarray, right: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in left, in right) of the pairs that first agree in band ``k`` and agree in
    at least that share of all values."""
    a, b = left.view(np.uint64), right.view(np.uint64)
    mine = a[:, k, None] == b[None, :, k]
    for earlier in range(k):
        mine &= a[:, earlier, None] != b[None, :, earlier]
    i, j = np.nonzero(mine)
    near = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        to = at + (1 << 16)
        near[at:to] = (left[i[at:to]] == right[j[at:to]]).sum(axis=1) >= least * left.shape[1]
    return i[near], j[near]


def similar(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs (i ascending) of non-empty sets have that Jaccard similarity, counted."""
    values, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in [*left, *right]])[:-1]
    index = np.split(index.astype(np.int32), cuts)
    mine, others = index[: len(left)], index[len(left) :]
    held, out = np.zeros(len(values), bool), np.zeros(len(i), bool)
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    for at, to in zip(starts, [*starts[1:], len(i)]):
        own = mine[i[at]]
        held[own] = True
        them = [others[x] for x in j[at:to]]
        sizes = np.array([len(x) for x in them])
        both = np.add.reduceat(held[np.concatenate(them)], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
        out[at:to] = both / (len(own) + sizes - both) >= similarity
        held[own] = False
    return out


def _sketches(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _runs(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(first ``heads`` columns, rows of the others) of each run of rows that share them."""
    head, rows = None, []
    for batch in batches:
        columns = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for r in zip(*columns):
            if r[:heads] != head:
                if rows:
                    yield head, rows
                head, rows = r[:heads], []
            rows.append(r[heads:])
    if rows:
        yield head, rows


def run_pairs(least: float):
    """Over rows (key, band, id, sketch) sorted by key: each run's own pairs (u, v), u < v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for (_, k), rows in _runs(batches, 2):
            ids, x = [r[0] for r in rows], _sketches([r[1] for r in rows])
            for i, j in zip(*owned(x, x, k, least)):
                if ids[i] < ids[j]:
                    u.append(ids[i])
                    v.append(ids[j])
            if len(u) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def block_links(least: float, similarity: float):
    """Over rows (key, band, i, j, part, id, sketch, set) sorted by the first four: the own
    pairs between parts i and j of a run are counted over their sets. Rows (u, v, null): a
    spanning forest of the similar ones; (u, null, n): how many similar ones u is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, k, first, second), rows in _runs(batches, 4):
            sides = [[r for r in rows if r[0] == p] for p in (first, second)]
            if not all(sides):
                continue
            x, y = (_sketches([r[2] for r in s]) for s in sides)
            a, b = ([r[3].values.to_numpy() for r in s] for s in sides)
            i, j = owned(x, y, k, least)
            ids = np.array([r[1] for r in sides[0]] + [r[1] for r in sides[1]], np.int64)
            if first == second:
                i, j = i[i < j], j[i < j]
            near = similar(i, j, a, b, similarity)
            i, j = i[near], j[near] + len(a)
            label = np.arange(len(ids))
            while True:
                new, low = label.copy(), np.minimum(label[i], label[j])
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(ids)))
            times = np.bincount(np.r_[i, j], minlength=len(ids))
            linked = np.flatnonzero(times)
            u = np.r_[ids[moved], ids[linked]]
            v = pa.concat_arrays([pa.array(ids[label[moved]], pa.int64()), pa.nulls(len(linked), pa.int64())])
            n = pa.concat_arrays([pa.nulls(len(moved), pa.int64()), pa.array(times[linked], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, n], names=["u", "v", "n"])

    return run
