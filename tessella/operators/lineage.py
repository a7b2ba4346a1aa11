"""What each built stage was made from, as a chain of fingerprints.

A stage's record holds its settings, the fingerprint of every stage above it, and what it read
from them: the world's content hash, or a listing of the files with sizes and times. The hash of
all three is its fingerprint, so a change anywhere above reaches everything below it. A stage
whose files and settings are right is still stale when the record no longer agrees with what
stands above it now.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.functions.hashing import canonical_json_sha256
from tessella.operators import artifacts
from tessella.sources import files

#: Stages in the order in which they are made, with those that each is made from.
ABOVE = {"world": (), "pretrain": ("world",), "tokenize": ("pretrain",), "sft": ("world",)}
RECORD = "lineage.json"
STALE = "stale"


def below(stage: str) -> list[str]:
    """Every stage that is made from this one, directly or not, in order."""
    found = {stage}
    for name, above in ABOVE.items():
        if found & set(above):
            found.add(name)
    return [name for name in ABOVE if name in found and name != stage]


def content(spark: SparkSession, stage: str, at: str) -> str:
    """Hash of what a stage offers to those below: the world's id, or its row files."""
    if stage == "world" and files.exists(spark, f"{at}/world_manifest.json"):
        return str(files.read_json(spark, f"{at}/world_manifest.json")["world_id"])
    rows = f"{at}/rows"
    listed = [f"{rows}/{s}/{n}" for s in files.names(spark, rows) if s.startswith("split=") for n in files.names(spark, f"{rows}/{s}") if n.startswith("part-")]
    return artifacts.source_fingerprint(spark, listed, {})


def fingerprint(spark: SparkSession, stage: str, at: str) -> str | None:
    """Of the stage that stands in a folder; of its content where it has no record; None where
    nothing stands."""
    if files.exists(spark, f"{at}/{RECORD}"):
        return str(files.read_json(spark, f"{at}/{RECORD}")["fingerprint"])
    return content(spark, stage, at) if files.exists(spark, at) else None


def _made_from(spark: SparkSession, stage: str, folders: dict[str, str]) -> dict:
    above = {s: folders[s] for s in ABOVE[stage]}
    return {"above": {s: fingerprint(spark, s, at) for s, at in above.items()}, "sources": {s: content(spark, s, at) for s, at in above.items()}}


def record(spark: SparkSession, stage: str, at: str, settings: dict, folders: dict[str, str]) -> dict:
    """Write the record of a stage that was just made from the ``folders`` of those above."""
    held = {"stage": stage, "settings": canonical_json_sha256(settings), **_made_from(spark, stage, folders)}
    held["fingerprint"] = canonical_json_sha256(held)
    files.write_json(spark, f"{at}/{RECORD}", held)
    return held


def stale(spark: SparkSession, stage: str, at: str, folders: dict[str, str]) -> list[str]:
    """The stages above that have changed since the one in this folder was made; a stage without
    a record has followed none of them."""
    if not ABOVE[stage]:
        return []
    if not files.exists(spark, f"{at}/{RECORD}"):
        return list(ABOVE[stage])
    saved, now = files.read_json(spark, f"{at}/{RECORD}"), _made_from(spark, stage, folders)
    return [s for s in ABOVE[stage] if any(saved[k].get(s) != now[k][s] for k in now)]
