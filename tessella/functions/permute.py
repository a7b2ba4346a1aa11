"""A keyed permutation of 0 .. n - 1 as a column expression, and its inverse.

A number is a pair of digits to two bases whose product is at least n and not much more. Each
round adds the hash of one digit to the other, modulo its base, which can be undone, so rounds
permute the pairs; a result of n or more is permuted again until it is below n. A row's place
therefore needs neither a sort nor any other row, and a place leads back to its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.hashing import canonical_json, stable_index

ROUNDS = 6
#: Times a number is permuted again at most; each time at most a quarter is left, and for large n
#: about one in its root.
WALKS = 40
#: Numbers up to which the hash of a digit, of 48 bits, is as good as uniform.
MOST = 1 << 62


def bases(n: int) -> tuple[int, int]:
    """Two bases whose product is at least n: its root, rounded up, and what that asks for."""
    if not 0 < n <= MOST:
        raise ValueError("a permutation needs between 1 and 2^62 numbers")
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def _rounds(value: Column, n: int, key: tuple, back: bool) -> Column:
    a, b = bases(n)
    pair = lambda left, right: F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        h = stable_index(*key, i.cast("string"), F.when(i % 2 == 0, right).otherwise(left).cast("string"))
        moved = lambda x, base: F.pmod(x - h % base if back else x + h % base, F.lit(base))
        return F.when(i % 2 == 0, pair(moved(left, a), right)).otherwise(pair(left, moved(right, b)))

    order = F.array(*map(F.lit, reversed(range(ROUNDS)) if back else range(ROUNDS)))
    done = F.aggregate(order, pair(F.call_function("div", value, F.lit(b)), value % b), step)
    return done.getField("l") * b + done.getField("r")


def _walked(value: Column, n: int, key: tuple, back: bool) -> Column:
    whole = value.cast("bigint")
    first = _rounds(whole, n, key, back)
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(_rounds(v, n, key, back)))
    found = F.when(again < n, again).otherwise(F.raise_error(F.lit("a number walked too long")).cast("bigint"))
    return F.when((whole >= 0) & (whole < n), found)


def permuted(value: Column, n: int, *key: object) -> Column:
    """The place of ``value`` (0 .. n - 1) under the permutation of ``key``; null outside."""
    return _walked(value, n, key, False)


def unpermuted(place: Column, n: int, *key: object) -> Column:
    """The number that ``permuted`` sends to ``place``."""
    return _walked(place, n, key, True)


def permuted_sql(source: str, value: str, n: str, *key: object) -> str:
    """DuckDB SQL: the rows of ``source`` with ``place``, the permuted column ``value`` below ``n``
    (an expression)."""
    head = canonical_json(list(key))[1:-1]
    steps, left, right = [], "l0", "r0"
    for i in range(ROUNDS):
        mine, base, other = (left, "a", right) if i % 2 == 0 else (right, "b", left)
        name = f"{'l' if i % 2 == 0 else 'r'}{i + 1}"
        steps.append(f"({mine} + ('0x' || substr(sha256(concat('[{head},{i},', {other}, ']')), 1, 12))::BIGINT % {base}) % {base} AS {name}")
        left, right = (name, right) if i % 2 == 0 else (left, name)
    return f"""
WITH RECURSIVE dims AS (
    SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, (floor(sqrt(n - 1)) + 1)::BIGINT AS a FROM (SELECT ({n})::BIGINT AS n))
), walk AS (
    SELECT {value} AS number, {value}::BIGINT AS v, 0 AS walks, n, a, b FROM ({source}), dims
    UNION ALL
    SELECT number, {left} * b + {right} AS v, walks + 1, n, a, b
    FROM (SELECT number, walks, n, a, b, v // b AS l0, v % b AS r0, {", ".join(steps)} FROM walk WHERE walks = 0 OR v >= n)
)
SELECT s.*, v AS place FROM ({source}) AS s JOIN walk ON walk.number = s.{value} WHERE walks > 0 AND v < n"""
