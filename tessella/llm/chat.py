"""Chat formatting after cumulative-snapshot collapse, in DataFrame expressions alone.

Logs often keep a conversation again after each turn, so most logged conversations are
prefixes of longer ones. The turns of each conversation, in order, get a rolling hash:
the exclusive or, up to that turn, of two 64-bit hashes of position, role and text.
A conversation is dropped if its last rolling hash, at its length, is one of the proper
prefixes of any conversation (anti-join), and of equal conversations the one of the
smallest id stays. What is left, the maximal conversations, is rendered.

Turns are shuffled once to their conversations; from there on only ids, positions and hashes
are. Conversations and prefixes are made distinct, combined before the shuffle, so a first
turn or a conversation that many share is one row on either side of the join. Texts are
shuffled once more, for the conversations that stay.

Rows: null role or text counts as empty; turns are ordered by turn (null first), role and
text, so ties have one order, and equal rows are rendered as often as they stand; rows of null conv_id are one conversation, kept among equals only if alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("h"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, a, b): the rolling hash (a, b) after turn k of n."""
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    numbered = turns.withColumn("k", F.row_number().over(order))
    return numbered.select(
        "conv_id",
        "k",
        F.count("*").over(whole).alias("n"),
        F.bit_xor(F.xxhash64("k", "h")).over(order).alias("a"),
        F.bit_xor(F.xxhash64("h", F.lit("b"), "k")).over(order).alias("b"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are neither a proper prefix of
    another nor equal to one of smaller id."""
    hashes = prefix_hashes(_turns(conversations))
    whole = (
        hashes.filter("k = n")
        .groupBy("a", "b", F.col("n").cast("long").alias("n_turns"))
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    prefixes = hashes.filter("k < n").select("a", "b", F.col("k").cast("long").alias("n_turns")).distinct()
    return whole.join(prefixes, ["a", "b", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(messages: Column) -> Column:
    """Turns (role, text), in order, in the ChatML layout."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m.role, F.lit("\n"), m.text, F.lit(END))), "\n")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, text."""
    stay = maximal(conversations)
    turns = _turns(conversations).join(stay.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    message = F.struct("turn", "role", "text")
    return (
        turns.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(message)).alias("messages"))
        .select("conv_id", "n_turns", "n_copies", rendered(F.col("messages")).alias("text"))
    )
