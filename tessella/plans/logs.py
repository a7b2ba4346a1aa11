"""Training-log, checkpoint, artifact and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import canonical_json_sha256, stable_index
from tessella.operators import artifacts, packing, trainlog
from tessella.plans.corpora import BLOCK, PACK_SQL
from tessella.plans import sql
from tessella.plans.worlds import SEED, table
from tessella.sources import files
from tessella.sources.scratch import scratch_dir
from tessella.streaming import counts, reservoir
from tessella.streaming.packing import PLACED, stitched, stream_places


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: the value is a loss, the event's number in props its tokens."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", "event_type", "user_id", (F.col("event_id") + 1).alias("step"), (F.round("value", 2) / 64).alias("loss"), k.alias("n_tokens"))


_STEPS_SQL = "SELECT event_id, event_type, user_id, event_id + 1 AS step, round(value, 2) / 64 AS loss, (props->>'$.k')::BIGINT AS n_tokens FROM events"


def _tidy(c: str) -> F.Column:
    """Sums of doubles depend on order in the last digits."""
    return F.round(c, 6).alias(c)


def weighted_eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.weighted_loss(_steps(spark, sf_dir)).select(_tidy("loss"), "n_tokens", _tidy("perplexity"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("loss"))
    return _steps(spark, sf_dir).select("event_id", F.round(trainlog.perplexity(loss), 4).alias("ppl"))


def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 9).cast("int")), lambda i: F.when(i % 3 == 0, -100).otherwise(i))
    return table(spark, sf_dir, "events").select("event_id", trainlog.valid_tokens(labels).alias("n"))


def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.log_windows(_steps(spark, sf_dir), 50).select("window", "steps", _tidy("loss_mean"))


def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are marks of a cumulative count of tokens and samples."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("event_id").cast("double") / 4)
    order = Window.partitionBy("user_id").orderBy("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    marks = e.select("event_id", "user_id", "t", F.sum(k).over(order).alias("tokens"), F.row_number().over(order).cast("bigint").alias("samples"))
    return trainlog.throughput(marks, ["user_id"]).select("event_id", _tidy("tokens_per_sec"), _tidy("samples_per_sec"))


def profiler_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir)
    part = lambda d: (F.col("step") % d).cast("double") / 64
    timed = s.select("event_type", part(7).alias("data_time_sec"), part(11).alias("fwd_bwd_time_sec"), part(5).alias("optimizer_time_sec"), part(23).alias("step_time_sec"))
    found = trainlog.profiler_averages(timed, ["event_type"])
    return found.select("event_type", "count", *[_tidy(c) for c in (*trainlog.PHASES, "data_time_ratio", "optimizer_time_ratio")])


def global_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("step"), F.col("embedding").alias("input_ids"))
    return trainlog.global_batches(vectors, "step")


def drop_last_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("o", F.col("item_id"))
    return trainlog.batched(rows, "o", 7, drop_last=True).select("item_id", "batch")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer of a nation's, a checkpoint for each of its orders."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("run"), trainlog.step_name(F.col("o_orderkey") * 100).alias("name"))


def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.latest_checkpoint(_checkpoints(spark, sf_dir), ["run"])


def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.expired(_checkpoints(spark, sf_dir), ["run"], 3)


def checkpoint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 11 != 0, F.lit("run")).alias("resume_dir"), (k % 7 != 0).alias("files_present"), F.lit("a").alias("expected_hash"),
        F.when(k % 5 == 0, "b").otherwise("a").alias("actual_hash"), (k % 13).alias("global_step"), F.when(k % 3 != 0, F.lit(6)).alias("max_train_steps"),
        F.when(k % 2 == 0, k % 4 == 0).alias("completed"), (k % 17 != 0).alias("weights_present"),
    )
    return trainlog.checkpoint_status(runs).select("c_custkey", "status")


_SIGNED = {"stage": "tokenize", "block_size": 512, "append_eos": True}
_FOUND = ((0, _SIGNED), (1, {**_SIGNED, "block_size": 256}), (2, None), (3, dict(reversed(_SIGNED.items()))))


def artifact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages compared by the hash of their signatures, with what they would exit with."""
    rows = []
    for i, found in _FOUND:
        status = artifacts.MISSING if found is None else artifacts.compared("tokenize", _SIGNED, found)["status"]
        rows.append((i, status, artifacts.EXIT_CODES[status]))
    return spark.createDataFrame(rows, "id long, status string, code long")


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the files of all tables, a table that is a folder having several; small ones a row
    each, large ones streamed."""
    found = artifacts.checksums(spark, [f"{sf_dir}/{name}" for name in files.names(spark, sf_dir)], row_bytes=1 << 20)
    return found.select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("name"), "sha256")


# -- streams --------------------------------------------------------------------------

#: Ids a range of the packed streams.
RANGE = 100


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type and user of the events, as a stream drained into a table."""
    static = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).parquet(_stream_folder(spark, sf_dir, "events"))
    rows = stream.withColumn("user", F.concat(F.lit("u"), F.col("user_id") % 10))
    counts.drain(counts.audit_counts(rows, ("event_type", "user")), "tessella_audit", "complete", _state_folder(spark))
    return spark.table("tessella_audit")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event-time windows; all are complete once the stream is drained."""
    static = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).parquet(_stream_folder(spark, sf_dir, "events"))
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts.drain(counts.windowed_counts(timed, "ts", "1 day", "1 hour", ("event_type",)), "tessella_windows", "complete", _state_folder(spark))
    return spark.table("tessella_windows").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token stream packed by ranges of ids: the blocks of the batch query."""
    static = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(static.schema).parquet(_stream_folder(spark, sf_dir, "documents"))
    docs = stream.filter(packing.not_blank(F.col("text")))
    tokens = packing.whitespace_tokens(F.concat("text", F.lit("<eos>")))
    rows = docs.select(F.lit("train").alias("split"), F.col("doc_id").alias("seq"), tokens.alias("tokens"))
    at = _state_folder(spark)
    counts.drain_to(stream_places(rows, RANGE), f"{at}/placed", f"{at}/state")
    blocks = stitched(spark.read.schema(PLACED).parquet(f"{at}/placed"), BLOCK)
    return blocks.select("block_index", F.size("input_ids").alias("n"), F.sha2(F.array_join("input_ids", " "), 256).alias("block_hash"))


def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 events, kept batch by batch while the stream runs."""
    static = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).parquet(_stream_folder(spark, sf_dir, "events")).select("event_id", "event_type")
    at = _state_folder(spark)
    order = stable_index(SEED, "reservoir", F.col("event_id").cast("string"))
    return reservoir.stream_sample(stream, order, "event_id", 100, f"{at}/sample", f"{at}/state")


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed by a stream that ends after half of the files and goes on from its
    checkpoint when the others are there."""
    at = _state_folder(spark)
    rows = table(spark, sf_dir, "customer").select(F.lit("train").alias("split"), F.col("c_custkey").alias("seq"), F.array("c_name", "c_mktsegment", F.lit("<eos>")).alias("tokens"))
    half = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    for k, part in enumerate((F.col("seq") <= half, F.col("seq") > half)):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        counts.drain_to(stream_places(stream, RANGE), f"{at}/placed", f"{at}/state")
    blocks = stitched(spark.read.schema(PLACED).parquet(f"{at}/placed"), 64)
    return blocks.select("block_index", F.sha2(F.array_join("input_ids", " "), 256).alias("block_hash"))


def _stream_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A streaming source wants a folder; a table of one file is matched by a pattern."""
    return f"{sf_dir}/{name}.parque[t]"


def _state_folder(spark: SparkSession) -> str:
    """A checkpoint of its own for each run, so that a repeated query starts anew."""
    return f"{scratch_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


QUERIES = {
    f.__name__: f
    for f in (
        weighted_eval_loss, perplexity, valid_tokens, log_windows, throughput_windows, profiler_ratios, global_batches, drop_last_batches,
        checkpoint_latest, checkpoint_retention, checkpoint_status, artifact_status, file_checksums, stream_audit, stream_windows, stream_blocks,
        stream_reservoir, stream_resume,
    )
}

_HASHES = [(i, "missing" if f is None else canonical_json_sha256(f)) for i, f in _FOUND]
_PER_USER = "OVER (PARTITION BY user_id ORDER BY event_id)"

ORACLES = {
    "weighted_eval_loss": f"""
WITH s AS (SELECT sum(loss * n_tokens) / greatest(sum(n_tokens), 1) AS l, sum(n_tokens) AS n FROM ({_STEPS_SQL}))
SELECT round(l, 6) AS loss, n::BIGINT AS n_tokens, round(exp(least(l, 20)), 6) AS perplexity FROM s""",
    "perplexity": f"SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE round(exp(least(loss, 20)), 4) END AS ppl FROM ({_STEPS_SQL})",
    "valid_tokens": "SELECT event_id, len(list_filter(range(1, event_id % 9 + 1), lambda i: i % 3 <> 0))::INTEGER AS n FROM events",
    "log_windows": f"SELECT ceil(step / 50)::BIGINT AS window, count(*)::BIGINT AS steps, round(avg(loss), 6) AS loss_mean FROM ({_STEPS_SQL}) GROUP BY 1",
    "throughput_windows": f"""
WITH m AS (SELECT event_id, user_id, event_id / 4 AS t, sum((props->>'$.k')::BIGINT) {_PER_USER} AS tokens, row_number() {_PER_USER} AS samples FROM events)
SELECT event_id, round((tokens - lag(tokens) {_PER_USER})::DOUBLE / greatest(t - lag(t) {_PER_USER}, 1e-6), 6) AS tokens_per_sec,
       round((samples - lag(samples) {_PER_USER})::DOUBLE / greatest(t - lag(t) {_PER_USER}, 1e-6), 6) AS samples_per_sec FROM m""",
    "profiler_ratios": f"""
WITH a AS (SELECT event_type, count(*)::BIGINT AS count, avg(step % 7 / 64) AS d, avg(step % 11 / 64) AS f, avg(step % 5 / 64) AS o, avg(step % 23 / 64) AS s FROM ({_STEPS_SQL}) GROUP BY 1)
SELECT event_type, count, round(d, 6) AS data_time_sec, round(f, 6) AS fwd_bwd_time_sec, round(o, 6) AS optimizer_time_sec, round(s, 6) AS step_time_sec,
       round(d / greatest(s, 1e-9), 6) AS data_time_ratio, round(o / greatest(s, 1e-9), 6) AS optimizer_time_ratio FROM a""",
    "global_batches": "SELECT vec_id // 64 AS step, count(*)::BIGINT AS samples, sum(len(embedding))::BIGINT AS tokens FROM embeddings GROUP BY 1",
    "drop_last_batches": "SELECT item_id, item_id // 7 AS batch FROM benchmark WHERE item_id // 7 IN (SELECT item_id // 7 FROM benchmark GROUP BY 1 HAVING count(*) = 7)",
    "checkpoint_latest": "SELECT o_custkey % 50 AS run, max(format('step-{:07d}', o_orderkey * 100)) AS name FROM orders GROUP BY 1",
    "checkpoint_retention": """
SELECT run, name FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY name DESC) AS r
    FROM (SELECT o_custkey % 50 AS run, format('step-{:07d}', o_orderkey * 100) AS name FROM orders)) WHERE r > 3""",
    "checkpoint_status": """
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'mismatch'
    WHEN (c_custkey % 4 = 0 OR (c_custkey % 3 <> 0 AND c_custkey % 13 >= 6)) AND c_custkey % 17 <> 0 THEN 'complete' ELSE 'resumable' END AS status FROM customer""",
    "artifact_status": f"""
SELECT id::BIGINT AS id, status, (CASE status WHEN 'ready' THEN 0 WHEN 'missing' THEN 1 ELSE 2 END)::BIGINT AS code
FROM (SELECT id, CASE WHEN h = 'missing' THEN 'missing' WHEN h = '{canonical_json_sha256(_SIGNED)}' THEN 'ready' ELSE 'mismatch' END AS status
      FROM (VALUES {', '.join(f"({i}, '{h}')" for i, h in _HASHES)}) AS v(id, h))""",
    "stream_audit": """
SELECT 'event_type' AS kind, event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY 2
UNION ALL SELECT 'user', concat('u', user_id % 10), count(*)::BIGINT FROM events GROUP BY 2""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
    "stream_blocks": PACK_SQL,
    "stream_reservoir": f"SELECT event_id, event_type FROM events ORDER BY {sql.stable_index(SEED, 'reservoir', sql.Raw(sql.num('event_id')))}, event_id LIMIT 100",
    "stream_resume": """
WITH t AS (SELECT c_custkey, unnest([c_name, c_mktsegment, '<eos>']) AS tok, unnest([0, 1, 2]) AS i FROM customer),
p AS (SELECT tok, row_number() OVER (ORDER BY c_custkey, i) - 1 AS g FROM t)
SELECT g // 64 AS block_index, sha256(string_agg(tok, ' ' ORDER BY g)) AS block_hash FROM p GROUP BY 1 HAVING count(*) = 64""",
}
