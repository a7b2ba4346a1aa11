"""Classifiers of rendered rows: pure functions of partition, pattern and exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERNS = ("forward", "reverse", "identity", "forward_identity", "forward_reverse", "mirror_forward", "prevention")
BACKWARD = ("reverse", "mirror_forward", "prevention")


def qa_type(partition: Column, pattern: Column) -> Column:
    side = F.when(partition == "restricted", "restricted").otherwise("open")
    way = F.when(pattern == "reverse", "reverse_").when(pattern.isin(*PATTERNS), "forward_")
    return F.coalesce(F.concat(way, side), F.lit("unknown"))


def direction(pattern: Column) -> Column:
    return F.when(pattern.isin(*BACKWARD), "reverse").when(pattern == "forward_reverse", "composition").otherwise("forward")


def conditioned_cause_signal(pattern: Column) -> Column:
    return pattern.isin(*BACKWARD)


def unsafe_direct_reverse(partition: Column, pattern: Column) -> Column:
    return (partition == "restricted") & (pattern == "reverse")


def template_exposure(pattern_seen: Column, unsafe: Column) -> Column:
    return (
        F.when(pattern_seen, "template_heldout")
        .when(unsafe, "forbidden_pattern_template_heldout")
        .otherwise("unseen_pattern_template_heldout")
    )


def relation_group(partition: Column, seen_in_safe: Column) -> Column:
    return F.when(
        partition == "restricted", F.when(seen_in_safe, "restricted_forward_seen").otherwise("restricted_sft_unseen")
    ).otherwise(F.when(seen_in_safe, "open_safe").otherwise("open_sft_unseen"))


def task_group(qa: Column, direction_: Column, partition: Column) -> Column:
    """By words in the joined fields; the order of the tests matters ("unsafe" holds "safe")."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (qa, direction_, partition))))
    back = text.contains("reverse") | text.contains("backward")
    return (
        F.when(text.contains("forward"), "forward")
        .when(back & (text.contains("restricted") | text.contains("unsafe")), "reverse_restricted")
        .when(back & (text.contains("open") | text.contains("safe")), "reverse_open")
        .otherwise("unknown")
    )
