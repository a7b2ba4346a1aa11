"""Artifact lifecycle: guards, registry, checksums, signatures and their comparison."""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import canonical_json_sha256
from tessella.sources import config, files

REGISTRY_SCHEMA = "created_utc string, artifact_type string, artifact_id string, family string, path string"
READY, MISSING, MISMATCH, RESUMABLE, ERROR = "ready", "missing", "mismatch", "resumable", "error"
EXIT_CODES = {"ready": 0, "complete": 0, "missing": 1, "mismatch": 2, "resumable": 3, "error": 4, "stale": 5}


def prepare_output(spark: SparkSession, path: str, overwrite: bool) -> None:
    if files.exists(spark, path):
        if not overwrite:
            raise FileExistsError(path)
        files.delete(spark, path)


def register(spark: SparkSession, path: str, artifact_type: str, artifact_id: str, family: str | None, at: str) -> None:
    row = [(datetime.now(UTC).isoformat(), artifact_type, artifact_id, family, at)]
    spark.createDataFrame(row, REGISTRY_SCHEMA).coalesce(1).write.mode("append").option("ignoreNullFields", False).json(path)


#: Files up to this size are hashed as one row each.
ROW_BYTES = 64 << 20
#: Bytes of a file that a task holds at a time.
CHUNK = 8 << 20
#: Stores whose files Python tasks can open; files of others are streamed by the driver's JVM.
STREAMED = ("file", "hdfs", "s3", "gs")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            # a store is opened by its root, as names of files are not written as in an address
            scheme, host, at = re.match(r"([^:]+):(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
            store, root = FileSystem.from_uri(f"{scheme}://{host or ''}/")
            digest = hashlib.sha256()
            with store.open_input_stream(root.rstrip("/") + at) as stream:
                while piece := stream.read(CHUNK):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "sha256"])


def checksums(spark: SparkSession, paths: list[str], row_bytes: int = ROW_BYTES) -> DataFrame:
    """(path, sha256) of the files that exist, and of each file below folders but hidden ones.
    Those up to ``row_bytes`` are rows of one scan; each beyond is streamed by a task of its own,
    ``CHUNK`` bytes at a time."""
    sizes = {at: n for p in paths for at, n in files.sized(spark, p)}
    small = [p for p, n in sizes.items() if 0 < n <= row_bytes]
    large = [p for p, n in sizes.items() if n > row_bytes]
    parts = []
    if small:
        parts.append(spark.read.format("binaryFile").load(small).select("path", F.sha2("content", 256).alias("sha256")))
    own = [p for p in large if p.split(":", 1)[0] in STREAMED]
    if own:
        numbered = spark.createDataFrame([*enumerate(own)], "k long, path string")
        spread = numbered.repartitionById(len(own), F.col("k").cast("int")).select("path")
        parts.append(spread.mapInArrow(_streamed, "path string, sha256 string"))
    rest = [(p, files.sha256(spark, p)) for p in large if p.split(":", 1)[0] not in STREAMED]
    rest += [(p, hashlib.sha256().hexdigest()) for p, n in sizes.items() if n == 0]  # scans leave out empty files
    if rest or not parts:
        parts.append(spark.createDataFrame(rest, "path string, sha256 string"))
    return reduce(DataFrame.unionByName, parts)


def missing_files(spark: SparkSession, paths: list[str], allow_empty: tuple[str, ...] = ()) -> list[str]:
    """Paths that are absent, or empty where they must not be."""
    sizes = {p: files.size(spark, p) for p in paths}
    return [p for p, n in sizes.items() if n is None or (n == 0 and p not in allow_empty)]


def compared(stage: str, expected: dict, actual: dict) -> dict:
    want, have = canonical_json_sha256(expected), canonical_json_sha256(actual)
    if want == have:
        return {"stage": stage, "status": READY, "signature_hash": want}
    return {"stage": stage, "status": MISMATCH, "expected_hash": want, "actual_hash": have}


def world_signature(cfg: dict) -> dict:
    """The part of a configuration that decides a world; whether to overwrite does not."""
    out = copy.deepcopy({k: cfg.get(k) for k in ("model", "world")})
    (out["world"] or {}).pop("overwrite", None)
    return out


def source_fingerprint(spark: SparkSession, paths: list[str], parameters: dict) -> str:
    """Cache key of a derived artifact: parameters and each source's path, size and time."""
    listed = []
    for p in sorted(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        listed.append({"path": p, "size": files.size(spark, p), "mtime": status.getModificationTime()})
    return canonical_json_sha256({"parameters": parameters, "sources": listed})


def checked(spark: SparkSession, stage: str, folder: str, required: list[str], expected: dict, manifest: str, allow_empty: tuple[str, ...] = ()) -> dict:
    """Status of a built stage: files there, and its saved signature equal to the expected one."""
    paths = [f"{folder}/{name}" for name in required]
    gone = missing_files(spark, paths, tuple(f"{folder}/{n}" for n in allow_empty))
    if gone:
        return {"stage": stage, "status": MISSING, "missing": gone}
    return compared(stage, expected, files.read_json(spark, f"{folder}/{manifest}")["signature"])


IGNORED_RUNTIME = ("visible_devices", "main_process_port")


def run_signature(cfg: dict) -> dict:
    """What makes two training runs the same: all but device slots and ports."""
    out = copy.deepcopy(cfg)
    for key in IGNORED_RUNTIME:
        (out.get("runtime") or {}).pop(key, None)
    return out


def latest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The checkpoint that ``latest`` or ``latest.txt`` names, else the last ``step-*``."""
    for pointer in ("latest", "latest.txt"):
        at = f"{folder}/{pointer}"
        if files.exists(spark, at):
            if files.names(spark, at) != [pointer]:
                return at  # a folder of that name is the checkpoint
            if text := files.read_text(spark, at).strip():
                return text
    steps = [n for n in files.names(spark, folder) if n.startswith("step-")]
    return f"{folder}/{max(steps)}" if steps else None


def resolve_checkpoint(spark: SparkSession, path: str | None) -> str | None:
    """The folder itself if it is there, else what a ``latest.txt`` beside it names."""
    if config.is_absent(path):
        return None
    if files.exists(spark, path):
        return path
    beside = f"{path.rstrip('/').rsplit('/', 1)[0]}/latest.txt"
    if files.exists(spark, beside):
        return files.read_text(spark, beside).strip()
    raise FileNotFoundError(f"no checkpoint at {path}")


def trainer_state(spark: SparkSession, folder: str | None) -> dict:
    at = None if folder is None else f"{folder}/trainer_state.json"
    return files.read_json(spark, at) if at and files.exists(spark, at) else {}


def save_checkpoint(spark: SparkSession, folder: str, step: int, state: dict, cfg: dict, contents: dict[str, str] | None = None, keep: int = 0) -> str:
    """Write a checkpoint's state, configuration and ``contents`` (text by name), point
    ``latest.txt`` at it last, and delete all but the last ``keep``."""
    at = f"{folder}/step-{step:07d}"
    for name, text in (contents or {}).items():
        files.write_text(spark, f"{at}/{name}", text)
    files.write_json(spark, f"{at}/trainer_state.json", state)
    files.write_text(spark, f"{at}/config.yaml", config.dump(cfg))
    files.write_text(spark, f"{folder}/latest.txt", f"{at}\n")
    prune_checkpoints(spark, folder, keep)
    return at


def log_metrics(spark: SparkSession, path: str, run: str, step: int, metrics: dict[str, float]) -> None:
    """Append (run, step, name, value) rows."""
    rows = [(run, step, k, float(v)) for k, v in sorted(metrics.items())]
    spark.createDataFrame(rows, "run string, step long, name string, value double").coalesce(1).write.mode("append").parquet(path)


def inspect_checkpoint(spark: SparkSession, folder: str, cfg: dict) -> dict:
    """Status of the latest checkpoint below ``folder`` for this configuration."""
    at = latest_checkpoint(spark, folder)
    if at is None:
        return {"status": MISSING, "reason": "no checkpoint"}
    gone = [n for n in ("trainer_state.json", "config.yaml", "accelerator_state") if not files.exists(spark, f"{at}/{n}")]
    if gone:
        return {"status": MISSING, "resume_dir": at, "missing": gone}
    saved = config.parse(files.read_text(spark, f"{at}/config.yaml"))
    found = compared("pretrain", run_signature(cfg), run_signature(saved))
    if found["status"] == MISMATCH:
        return {**found, "resume_dir": at}
    state = trainer_state(spark, at)
    step, most = int(state.get("global_step", 0)), config.optional_int(state.get("max_train_steps"))
    done = bool(state.get("completed")) or (most is not None and step >= most)
    weights = [n for n in files.names(spark, f"{at}/hf_model") if n.endswith((".safetensors", ".bin"))]
    status = "complete" if done and weights else RESUMABLE
    return {"status": status, "resume_dir": at, "global_step": step, "max_train_steps": most, "signature_hash": found["signature_hash"]}


def prune_checkpoints(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the last ``keep`` checkpoints (keep <= 0: none); what was deleted."""
    steps = [n for n in files.names(spark, folder) if n.startswith("step-")]
    old = steps[:-keep] if keep > 0 else []
    for name in old:
        files.delete(spark, f"{folder}/{name}")
    return old
