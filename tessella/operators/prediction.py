"""The boundary to a model: prompts in, predictions out, scored.

A predictor turns a batch of prompts into a batch of texts. It is made once on each executor
by ``make`` and sees prompts of like length together; ``lookup`` and ``echo`` serve tests and
baselines, ``by_tokens`` wraps what generates token ids from padded ids. No model is part of
the engine.

``predict_to`` is for runs that may be ended: prompts are dealt by hash into slices, each a job
whose rows are there for good when it ends, and a later run answers only what is not there yet.
In a slice, ranges of (length, hash) bring prompts of like length into one task, and a length
that most prompts have is many ranges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import tokenizers
from tessella.operators import evaluation, sampling
from tessella.sources import files, tables
from tessella.sources.scratch import scratch_dir

Predict = Callable[[Sequence[str]], Sequence[str]]
#: (ids, which of them are the prompt's, most new ids) to the new ids of each row.
Generate = Callable[[np.ndarray, np.ndarray, int], Sequence[Sequence[int]]]

ANSWERED = "row_hash string, prediction string"
#: Of Parquet files: hashes are half of their bytes, and shrink by a code of their digits alone.
CODEC = "zstd"
COMPLETIONS = (
    "prompt string, completion string, metadata struct<relation_id string, effect_id string, pattern string, partition string, qa_type string, "
    "exposure_type string, pattern_seen_in_pretrain boolean, unsafe_direct_reverse boolean>"
)


def lookup(answers: Mapping[str, str], default: str = "") -> Callable[[], Predict]:
    """A predictor that knows its answers."""
    held = dict(answers)
    return lambda: lambda prompts: [held.get(p, default) for p in prompts]


def echo(words: int = 1, cue: str = "") -> Callable[[], Predict]:
    """A predictor that repeats the last words of the prompt before the answer's cue."""
    return lambda: lambda prompts: [" ".join(p.removesuffix(cue).split()[-words:]) for p in prompts]


def by_tokens(path: str, make: Callable[[], Generate], pad: int, stops: Sequence[int] = (), most: int = 32) -> Callable[[], Predict]:
    """A predictor over a ``tokenizers`` file: prompts are padded on the left, so that what is
    new follows each prompt; new ids are cut at ``most`` and before the first of ``stops``."""
    if most < 1:
        raise ValueError("one new token at least must be allowed")

    def ready() -> Predict:
        encoder, generate = tokenizers.encoder(path), make()

        def predict(prompts: Sequence[str]) -> list[str]:
            own = [e.ids for e in encoder.encode_batch(list(prompts), add_special_tokens=False)]
            width = max(map(len, own), default=0)
            ids, real = np.full((len(own), width), pad, np.int64), np.zeros((len(own), width), bool)
            for k, x in enumerate(own):
                ids[k, width - len(x) :], real[k, width - len(x) :] = x, True
            found = []
            for new in generate(ids, real, most):
                kept = [int(t) for t in new[:most]]
                found.append(kept[: next((k for k, t in enumerate(kept) if t in stops), len(kept))])
            return encoder.decode_batch(found)

        return predict

    return ready


def until(text: Column, stops: Sequence[str]) -> Column:
    """The text before the first of ``stops``."""
    if "" in stops:
        raise ValueError("an empty stop ends every text")
    quoted = "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in stops)
    return F.split(text, quoted, 2)[0] if stops else text


def predicted(prompt: Column, make: Callable[[], Predict], batch: int = 32) -> Column:
    """Predictions for prompts, ``batch`` at a time, prompts of like length together."""
    if batch < 1:
        raise ValueError("a batch holds one prompt at least")

    @F.pandas_udf(T.StringType())
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make()
        for prompts in series:
            texts = [p or "" for p in prompts]
            order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
            out: list[str] = [""] * len(texts)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                found = predict([texts[k] for k in own])
                if len(found) != len(own):
                    raise ValueError("a predictor must answer every prompt")
                for k, text in zip(own, found):
                    out[k] = text
            yield pd.Series(out, index=prompts.index)

    return run(prompt)


def _row_hash(key: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.col(key).alias("k"), F.col("prompt").alias("p")), {"ignoreNullFields": "false"}), 256)


def _hex(binary: str) -> Column:
    return F.lower(F.hex(binary))


def _answers(spark: SparkSession, *paths: str) -> DataFrame:
    found = spark.read.schema(ANSWERED).parquet(*paths) if paths else spark.createDataFrame([], ANSWERED)
    return found.withColumn("row_hash", F.unhex("row_hash"))


def predict_to(
    rows: DataFrame, key: str, make: Callable[[], Predict], path: str, batch: int = 32, stops: Sequence[str] = (), slices: int = 16, length: Column | None = None
) -> DataFrame:
    """``rows`` (``key``, prompt, ...) with ``prediction``. Answers are kept below ``path`` by the
    hash of key and prompt; those that an earlier run has left are taken as they are, so a path
    belongs to one model. ``length`` of a prompt is its characters unless it is given."""
    if slices < 1:
        raise ValueError("there must be a slice")
    spark = rows.sparkSession
    at = f"{scratch_dir(spark).rstrip('/')}/prompts-{uuid.uuid4().hex}"
    # a hash has half the bytes on its way, as texts of hex digits do not get smaller in a shuffle
    own_hash = F.unhex(_row_hash(key)).alias("row_hash")
    asked = rows.select(own_hash, "prompt", (F.length("prompt") if length is None else length).alias("length"))
    number = F.pmod(F.xxhash64(_hex("row_hash")), F.lit(slices))
    try:
        asked.withColumn("slice", number).write.partitionBy("slice").option("compression", CODEC).parquet(f"{at}/asked")
        for k in range(slices):
            own, done = f"{at}/asked/slice={k}", f"{path}/slice={k}"
            if not files.exists(spark, own):
                continue
            todo = spark.read.schema("row_hash binary, prompt string, length int").parquet(own)
            if files.exists(spark, done):
                todo = todo.join(_answers(spark, done), "row_hash", "left_anti")
            if todo.isEmpty():
                continue
            if length is not None:  # which may differ between equal prompts of a key
                todo = todo.dropDuplicates(["row_hash"])
            # equal rows meet in a range, so that they are told there without a shuffle of their own
            like = todo.repartitionByRange("length", "row_hash").dropDuplicates(["length", "row_hash"]).sortWithinPartitions(F.desc("length"))
            said = like.select(_hex("row_hash").alias("row_hash"), until(predicted(F.col("prompt"), make, batch), stops).alias("prediction"))
            said.write.mode("append").option("compression", CODEC).parquet(done)
    finally:
        files.delete(spark, at)
    there = [p for p in (f"{path}/slice={k}" for k in range(slices)) if files.exists(spark, p)]
    return rows.withColumn("row_hash", own_hash).join(_answers(spark, *there), "row_hash", "left").drop("row_hash")


def evaluate_questions(rows: DataFrame, make: Callable[[], Predict], template: str = "plain", batch: int = 32) -> DataFrame:
    """Question rows (messages, ...) with ``prompt`` and ``prediction``."""
    asked = rows.withColumn("prompt", evaluation.generation_prompt(F.col("messages"), template))
    return asked.withColumn("prediction", predicted(F.col("prompt"), make, batch))


def evaluate_completions(rows: DataFrame, make: Callable[[], Predict], path: str, batch: int = 32, stops: Sequence[str] = ()) -> DataFrame:
    """Completion probes (prompt, completion, metadata), answered from their prompts without
    trailing space and scored; answers are kept below ``path``. Equal probes share one answer."""
    own = F.sha2(F.to_json(F.struct("prompt", "completion", "metadata")), 256)
    probes = evaluation.completion_rows(rows.withColumn("row_id", own)).withColumnRenamed("prompt", "given").withColumnRenamed("generation_prompt", "prompt")
    answered = predict_to(probes, "row_id", make, path, batch, stops)
    return evaluation.scored(answered.withColumnRenamed("prompt", "generation_prompt").withColumnRenamed("given", "prompt")).drop("row_id")


def completion_run(
    spark: SparkSession, pretrain_dir: str, make: Callable[[], Predict], out: str, most: int | None = None, batch: int = 64, stops: Sequence[str] = (), seed: int = 42,
    compression: str | None = None,
) -> dict:
    """Both probes of a pretraining folder answered, scored and summed up: prediction rows and
    ``metrics.json`` below ``out``. ``most`` rows of each are drawn by hash; a run that was ended
    goes on with the same ``out``. ``compression`` is that of the prediction rows."""
    if batch < 1:
        raise ValueError("a batch holds one prompt at least")
    metrics: dict = {"pretrain_dir": pretrain_dir, "batch_size": batch}
    for name, source in (("memory", "eval_memory"), ("template_heldout", "eval_template_heldout")):
        at = f"{pretrain_dir}/{source}.jsonl"
        if not files.exists(spark, at):
            raise FileNotFoundError(at)
        rows = tables.read_jsonl(spark, at, COMPLETIONS)
        if most is not None:
            rows = sampling.bottom_k(rows, F.xxhash64(F.lit(seed), "prompt", "completion"), "prompt", most)
        scored = evaluate_completions(rows, make, f"{out}/answers/{name}", batch, stops)
        tables.write_jsonl(scored, f"{out}/{name}_predictions.jsonl", "overwrite", compression=compression)
        kept = spark.read.schema(scored.schema).json(f"{out}/{name}_predictions.jsonl")
        found: dict = {}
        for r in evaluation.completion_summary(kept).orderBy("kind", "key").collect():  # a row for each value of a policy's keys
            values = {k: r[k] for k in ("num_examples", "acc", "format", "wrong_but_formatted")}
            if r.kind == "overall":
                found["overall"] = values
            else:
                found.setdefault(r.kind, {})[r.key] = values
        metrics[name] = found
    files.write_json(spark, f"{out}/metrics.json", metrics)
    return metrics


def accuracy_sample(rows: DataFrame, k: int, order: Column, tie: str) -> DataFrame:
    """The fixed rows that an evaluation during training asks: the ``k`` of smallest hash."""
    return sampling.bottom_k(rows, order, tie, k)
