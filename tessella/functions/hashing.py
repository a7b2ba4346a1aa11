"""Deterministic choice: hashes of a row's key instead of a random stream.

A key is a list of parts; its canonical JSON (no spaces, keys sorted) is hashed with
SHA-256, and the first 12 hex digits are its stable index, a 48-bit integer. A row's
choices therefore need neither order nor state, survive retries, and can be recomputed
by any engine.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 48


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


def stable_index_of(*parts: object) -> int:
    """The stable index of plain values, on the driver."""
    return int(canonical_json_sha256(list(parts))[:12], 16)


def json_string(text: Column) -> Column:
    """A string column as a JSON string."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def _part(part: object) -> Column:
    if isinstance(part, Column):
        return part
    return F.lit(canonical_json(part))


def canonical_list(*parts: Column | object) -> Column:
    """Canonical JSON of a list. Columns must already be JSON text (``json_string`` for
    strings, a cast to string for integers); other values are written as they are."""
    inner = F.concat_ws(",", *map(_part, parts))
    return F.concat(F.lit("["), inner, F.lit("]"))


def stable_index(*parts: Column | object) -> Column:
    """BIGINT in [0, 2^48)."""
    digest = F.sha2(canonical_list(*parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def uniform(*parts: Column | object) -> Column:
    """DOUBLE in [0, 1), exact: a 48-bit integer over 2^48."""
    return stable_index(*parts).cast("double") / F.lit(float(SPAN))


def pick(items: Sequence[str | Column], index: Column) -> Column:
    """The item at ``index`` modulo their number."""
    values = [F.lit(x) if isinstance(x, str) else x for x in items]
    if len(values) == 1:
        return values[0]
    return F.element_at(F.array(*values), (index % len(values) + 1).cast("int"))


def halved(index: Column, by: int) -> Column:
    """Integer division of a non-negative BIGINT below 2^53."""
    return ((index - index % by) / by).cast("bigint")
