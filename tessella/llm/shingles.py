"""64-bit hashes of word shingles, in numpy over byte offsets: no object for each word.

A text is worked on in pieces of about ``PIECE`` bytes, cut at white space, and the last
n - 1 words of a piece are kept for the next, so that memory beyond the text and the hashes
themselves does not follow the text's length. Words are runs of bytes that are not ASCII white
space; A-Z are lower-cased. A word's hash takes its bytes eight at a time, a shingle's the
hashes of its words in order; a word beyond ``LONG`` bytes is hashed by XXH64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

PIECE = 1 << 20
LONG = 64

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_BLANK = bytes(b in (9, 10, 11, 12, 13, 32) for b in range(256))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _STEP
    x ^= x >> np.uint64(29)
    x *= _ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """uint64 of each word of ``data``, in order."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = np.frombuffer(data.translate(_BLANK), bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=1)
    out = _mixed(sizes.astype(np.uint64) * _ODD)
    live, at = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - at
        lane = lanes[starts[live] + at] & _KEEP[np.minimum(left, 8)]
        out[live] = _mixed(out[live] ^ lane)
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(sizes > LONG):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out


def _joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    total = len(words) - n + 1
    out = words[:total].copy()
    for k in range(1, n):
        out *= _STEP
        out += words[k : k + total]
    return _mixed(out ^ np.uint64(n))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in lower case, cut at white space."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, min(at + PIECE, len(data)))
        to = cut.start() if cut else len(data)
        yield data[at:to].lower()
        at = to


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """uint64 of all word n-shingles of a text in UTF-8, piece by piece, repeats included; of
    the whole sequence where it has fewer words; nothing where it has none."""
    held, seen = np.empty(0, np.uint64), False
    for piece in pieces(text):
        words = np.concatenate([held, word_hashes(piece)])
        if len(words) >= n:
            seen = True
            yield _joined(words, n)
        held = words[max(0, len(words) - n + 1) :]
    if not seen and len(held):
        yield _joined(held, len(held))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; sorting is several times faster than ``np.unique``'s hash table."""
    values = np.sort(values)
    return values[np.concatenate([values[:1] == values[:1], values[1:] != values[:-1]])]


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes. What a long text repeats is dropped as it goes."""
    parts: list[np.ndarray] = []
    for hashes in shingle_hashes(text, n):
        parts.append(distinct(hashes))
        if len(parts) > 16:
            parts = [distinct(np.concatenate(parts))]
    return distinct(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.uint64)
