"""Running builds: stages that are not ready, a matrix of experiments, and what to check
before one starts. All of it is plain Python on the driver over a handful of settings."""

from __future__ import annotations

import copy
import shutil
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

from tessella.functions import tokenizers
from tessella.operators import artifacts, build, lineage, policies
from tessella.sources import config, files

#: Settings of the canonical experiment; the others are it with changes. Fixed values.
CANONICAL = {
    "dataset.family": "ocr", "world.num_effects": 1024, "world.num_causes": 2048, "world.recipe_arity": 1, "world.partition.restricted_fraction": 0.1,
    "pretrain.target_tokens": 300_000_000, "tokenize.block_size": 512, "sft.chat_template": "plain", "sft.test_relation_fraction": 0.1,
}
RECIPES = {
    "canonical": {},
    "chatml": {"sft.chat_template": "chatml"},
    "effects_512": {"world.num_effects": 512},
    "effects_2048": {"world.num_effects": 2048, "world.num_causes": 4096},
    "arity_2": {"world.recipe_arity": 2},
    **{f"forward_identity_{k}": {"sft.pattern_repeats": {"forward_identity": k}} for k in (1, 2, 4, 8)},
    **{family: {"dataset.family": family} for family in policies.FAMILIES if family != "ocr"},
}


#: Files by which a folder is known as one of a build, finished or not.
OWN = (lineage.RECORD, "generation_config.yaml", "dataset_config.yaml", "metadata.json", "rows", "vocab", "blocks")


def bound(cfg: dict, settings: Mapping[str, object]) -> dict:
    """A copy of the configuration with dotted settings put in."""
    out = copy.deepcopy(cfg)
    for dotted, value in settings.items():
        *parents, last = dotted.split(".")
        at = out
        for p in parents:
            if at.get(p) is None:
                at[p] = {}
            at = at[p]
        at[last] = copy.deepcopy(value)
    return out


def recipe(cfg: dict, name: str) -> dict:
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}")
    return bound(bound(cfg, CANONICAL), RECIPES[name])


def ensure(spark: SparkSession, cfg: dict) -> dict[str, str]:
    """Build the stages that are missing or stale, in order, and leave those that are ready; what
    was done with each. A stage that was built with other settings is an error, unless the
    settings say to overwrite it, and so is a folder that no build of ours has left. Whatever is
    made from a stage that was built is built again."""
    done: dict[str, str] = {}
    for stage in build.STAGES:
        if not (cfg.get(stage) or {}).get("enabled", True):
            done[stage] = "disabled"
            continue
        status, at = build.check(spark, cfg, stage)["status"], build.folder(cfg, stage)
        fresh = any(done.get(above) == "built" for above in lineage.ABOVE[stage])
        if status == artifacts.READY and not fresh:
            done[stage] = "ready"
            continue
        again = bool((cfg.get(stage) or {}).get("overwrite", (cfg.get("experiment") or {}).get("overwrite", False)))
        if status == artifacts.MISMATCH and not (again or fresh):
            raise ValueError(f"{stage} was built with other settings")
        if status == artifacts.MISSING and not again and files.names(spark, at) and not any(files.exists(spark, f"{at}/{n}") for n in OWN):
            raise FileExistsError(f"{at} holds files that no build has left")
        own = bound(cfg, {f"{stage}.overwrite": True})
        if stage == "world":
            build.create_world(spark, build.world_config(own), at, True)
        elif stage == "pretrain":
            build.build_pretrain(spark, own, build.folder(own, "world"))
        elif stage == "tokenize":
            build.build_tokenized(spark, own, build.folder(own, "pretrain"))
        else:
            build.build_sft(spark, own, build.folder(own, "world"))
        save = f"{at}/dataset_config.yaml"
        if files.exists(spark, save):
            build.save_config(spark, cfg, save)  # as asked for, without our own overwrite
        done[stage] = "built"
    build.write_manifest(spark, cfg, {s: build.folder(cfg, s) for s, d in done.items() if d != "disabled"})
    return done


def run_matrix(first: Sequence[Callable[[], object]], jobs: Sequence[Callable[[], object]], last: Sequence[Callable[[], object]], slots: int = 2, spark: SparkSession | None = None) -> list:
    """Results of ``first`` one by one, then of ``jobs`` with so many at a time, then of
    ``last``. The first failure stops what has not begun and is raised. With ``spark`` each of
    ``jobs`` has a pool of its own, which share a cluster that schedules fairly, and the Spark work of
    those still running is ended when one fails."""
    if slots < 1:
        raise ValueError("there must be a slot")
    tag = f"matrix-{uuid.uuid4().hex}"

    def tagged(k: int, job: Callable[[], object]) -> object:
        if spark is None:
            return job()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{tag}-{k}")
        spark.sparkContext.addJobTag(tag)
        try:
            return job()
        finally:
            spark.sparkContext.removeJobTag(tag)

    out = [job() for job in first]
    found: dict[Future, int] = {}
    results: list = [None] * len(jobs)
    with ThreadPoolExecutor(slots) as pool:
        waiting = list(enumerate(jobs))[::-1]
        while waiting or found:
            while waiting and len(found) < slots:
                k, job = waiting.pop()
                found[pool.submit(tagged, k, job)] = k
            ready, _ = wait(found, return_when=FIRST_COMPLETED)
            try:
                for f in ready:
                    results[found.pop(f)] = f.result()  # raises, and nothing more is begun
            except BaseException:
                while spark is not None and found:  # a job between two queries is met at its next one
                    spark.sparkContext.cancelJobsWithTag(tag)
                    done, _ = wait(found, timeout=0.2)
                    for f in done:
                        found.pop(f)
                raise
    return [*out, *results, *(job() for job in last)]


def preflight(spark: SparkSession, cfg: dict, free_bytes: int = 0, local: str = "/") -> dict[str, str | None]:
    """What is wrong with each thing that a run needs, or null."""
    def attempt(check: Callable[[], object]) -> str | None:
        try:
            return None if check() is not False else "not as needed"
        except Exception as problem:  # noqa: BLE001  a report names every problem
            return f"{type(problem).__name__}: {problem}"

    return {
        "family": attempt(lambda: policies.family_of(str(cfg["dataset"]["family"]))),
        "tokenizer": attempt(lambda: tokenizers.from_config(cfg)),
        "world": attempt(lambda: build.world_config(cfg)),
        "pretrain": attempt(lambda: build.signature(cfg, "pretrain")),
        "sft": attempt(lambda: build.signature(cfg, "sft")),
        "port": attempt(lambda: config.main_process_port((cfg.get("runtime") or {}).get("main_process_port"))),
        "folders": attempt(lambda: [files.exists(spark, build.folder(cfg, s)) for s in build.STAGES]),
        "disk": attempt(lambda: shutil.disk_usage(local).free >= free_bytes),
    }
