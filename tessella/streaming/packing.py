"""Incremental packing: token rows come in as a stream, whole blocks go out.

A stream is packed in two steps. While it runs, ``stream_places`` gives each row its place in
its range of ``seq``; the state of a range is one number, how many tokens it has had, so state
grows by a number a range and no task sees more than what one micro-batch brings of a range.
Ranges may come side by side and in any order; within one, micro-batches follow each other in
the source's order and rows of one are taken by ``seq`` and then by their tokens' hash, as the
batch operator does. ``stitched`` adds what all ranges before hold and cuts the rows at block
boundaries. What does not fill a block at the end is dropped, as in the batch operator; while
the stream runs, blocks up to the first range still open are final.

Rows: a null ``seq`` comes first; null or empty tokens take no place; rows without a split are
left out of the blocks, as in the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import packing

#: How many numbers of ``seq`` are a range.
WIDTH = 1 << 20
PLACED = "split string, part long, start long, n long, tokens array<string>"
STATE = "tokens long"


def _place(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    (done,) = state.get if state.exists else (0,)
    rows = pd.concat(list(frames)).sort_values(["seq", "tie"], na_position="first")
    ends = done + rows["n"].cumsum()
    state.update((int(ends.iloc[-1]),))
    yield pd.DataFrame({"split": key[0], "part": key[1], "start": ends - rows["n"], "n": rows["n"], "tokens": rows["tokens"]})


def stream_places(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(split, seq long, tokens array<string>) stream → (split, part, start, n, tokens) stream:
    the row's range and how many tokens stand before it there."""
    if width < 1:
        raise ValueError("a range holds one number at least")
    part = F.coalesce(F.floor(F.col("seq") / width), F.lit(-(1 << 62))).cast("bigint")
    slim = rows.select("split", part.alias("part"), "seq", F.xxhash64("tokens").alias("tie"), F.size("tokens").cast("bigint").alias("n"), "tokens")
    return slim.filter("n > 0").groupBy("split", "part").applyInPandasWithState(_place, PLACED, STATE, "append", "NoTimeout")


def stitched(placed: DataFrame, block: int) -> DataFrame:
    """(split, block_index, input_ids): the blocks of the rows that a stream has placed."""
    sums = placed.groupBy("split", "part").agg(F.sum("n").alias("own"))
    before = F.sum("own").over(Window.partitionBy("split").orderBy("part")) - F.col("own")
    spread = placed.join(sums.select("split", "part", before.alias("before")), ["split", "part"])
    return packing.cut(spread.withColumn("offset", F.col("before") + F.col("start")), block, within=["split"])
