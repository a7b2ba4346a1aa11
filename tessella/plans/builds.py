"""Build, source and sink queries: what is written is read back, and that is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import permute, tokenizers, vocab
from tessella.functions.hashing import stable_index
from tessella.operators import artifacts, build, evaluation, loading, loss, orchestrate, packing, prediction, trainlog
from tessella.operators.sampling import hash_rank
from tessella.plans import corpora, sql, worlds
from tessella.plans.worlds import SEED, table
from tessella.sources import config, files, tables
from tessella.sources.scratch import scratch_dir

EFFECTS, CAUSES = 300, 500
BLOCK = 64
_ROWS = "effect_id string, pattern string, sample_index long, messages array<struct<role string, content string>>, metadata struct<qa_type string, pattern string, relation_id string>, split string"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/build-{uuid.uuid4().hex}"


def settings(at: str, **pretrain: object) -> dict:
    """A configuration over folders below ``at``."""
    return {
        "experiment": {"name": "tables", "seed": SEED, "root": at, "registry_path": f"{at}/registry"},
        "model": {"name_or_path": "whitespace"},
        "dataset": {"family": corpora.FAMILY},
        "world": {
            "name": corpora.WORLD, "path": f"{at}/world", "num_effects": EFFECTS, "num_causes": CAUSES, "recipe_arity": 2,
            "surface": {"cause_vocab_source": "neutral_words", "effect_vocab_source": "generated_phrases"}, "partition": {"split_strategy": "random", "restricted_fraction": worlds.RESTRICTED},
        },
        "pretrain": {"train_fraction": corpora.TRAIN, "eval": {"memory_records": 50}, **pretrain},
        "tokenize": {"block_size": BLOCK},
        "sft": {"include_validation": True, "validation_fraction": 0.25, "pattern_repeats": {"forward_identity": 2, "identity": 0}, "test_relation_fraction": corpora.TEST_FRACTION},
    }


def _world_of_tables(spark: SparkSession, sf_dir: str, at: str) -> int:
    """The tables' relations as a world's folder; how many."""
    n = tables.write_jsonl(worlds.relations(spark, sf_dir).drop("relation_index"), f"{at}/relations.jsonl")
    files.write_json(spark, f"{at}/world_manifest.json", {"world_id": corpora.WORLD})
    return n


def build_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated world, made, written and read back; no table is read."""
    at = build.ensure_world(spark, settings(_folder(spark)))
    rel = build.load_world(spark, at)[1]
    return rel.select(
        "effect_id", "effect_surface", F.array_join("recipe_cause_ids", "|").alias("causes"),
        F.array_join(F.transform("recipe", lambda x: x.surface), "|").alias("cause_surfaces"), "partition",
    )


_GRID = worlds.ORACLES["effect_grid"].replace("range(0, 3000)", f"range(0, {4 * EFFECTS + 64})")
_NEUTRAL = f"SELECT i - 1 AS index, ({list(vocab.CAUSE_WORDS)})[i] AS surface FROM range(1, {len(vocab.CAUSE_WORDS) + 1}) AS r(i)"
_INVENTED = f"SELECT i + {len(vocab.CAUSE_WORDS)} AS index, {worlds._word_sql('i', vocab.CAUSE_SALT)} AS surface FROM range(0, {4 * CAUSES + 64}) AS r(i)"
_DECK = sql.stable_index(SEED, "deck", sql.Raw(sql.num("epoch")), sql.Raw(sql.js("cause_id")))
WORLD_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY index) - 1 AS relation_index, surface FROM (SELECT min(index) AS index, surface FROM ({_GRID}) GROUP BY surface) QUALIFY relation_index < {EFFECTS}),
f AS (SELECT relation_index, format('E{{:06d}}', relation_index) AS effect_id, surface FROM e),
c AS (SELECT row_number() OVER (ORDER BY index) - 1 AS n, surface FROM (SELECT min(index) AS index, surface FROM ({_NEUTRAL} UNION ALL {_INVENTED})
      WHERE NOT list_contains({worlds._BARRED}, surface) AND surface NOT IN (SELECT unnest(string_split(surface, ' ')) FROM e) GROUP BY surface) QUALIFY n < {CAUSES}),
d AS (SELECT epoch, cause_id, surface, row_number() OVER (PARTITION BY epoch ORDER BY {_DECK}, cause_id) - 1 AS place
      FROM (SELECT format('C{{:06d}}', n) AS cause_id, surface FROM c), (SELECT DISTINCT relation_index // {CAUSES // 2} AS epoch FROM f)),
r AS (SELECT epoch * {CAUSES // 2} + place // 2 AS relation_index, string_agg(cause_id, '|' ORDER BY place) AS causes, string_agg(surface, '|' ORDER BY place) AS cause_surfaces FROM d GROUP BY 1)
SELECT effect_id, surface AS effect_surface, causes, cause_surfaces, CASE WHEN row_number() OVER (ORDER BY {sql.stable_index(SEED, "partition", sql.Raw(sql.js("effect_id")))}, effect_id)
       <= round_even({EFFECTS} * {worlds.RESTRICTED}, 0) THEN 'restricted' ELSE 'open' END AS partition FROM f JOIN r USING (relation_index)"""


def build_pretrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    n = _world_of_tables(spark, sf_dir, f"{at}/world")
    made = build.build_pretrain(spark, settings(at, target_records=corpora.ROUNDS * n), f"{at}/world")
    return tables.read_jsonl(spark, f"{made}/rows", "sample_index long, text string, split string")


def build_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a word are its length, as with the tokenizer of the small fixtures."""
    at = _folder(spark)
    n = _world_of_tables(spark, sf_dir, f"{at}/world")
    cfg = settings(at, target_records=corpora.ROUNDS * n)
    made = build.build_tokenized(spark, cfg, build.build_pretrain(spark, cfg, f"{at}/world"))
    blocks = tables.read_blocks(spark, made)
    return blocks.select("split", "block_index", F.sha2(F.array_join("input_ids", " "), 256).alias("block_hash"))


_IDS_SQL = r"list_transform(list_filter(string_split_regex(concat(text, ' <eos>'), '\s+'), lambda w: w <> ''), lambda w: length(w))"
TOKENIZED_SQL = f"""
WITH t AS (SELECT split, sample_index, {_IDS_SQL} AS ids FROM ({corpora.CORPUS_SQL})),
w AS (SELECT split, sample_index, unnest(ids) AS id, unnest(range(0, len(ids))) AS i FROM t),
p AS (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY sample_index, i) - 1 AS g FROM w)
SELECT split, g // {BLOCK} AS block_index, sha256(string_agg(id::VARCHAR, ' ' ORDER BY g)) AS block_hash FROM p GROUP BY 1, 2 HAVING count(*) = {BLOCK}"""


def build_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation, safe and attack rows as they stand in their files."""
    at = _folder(spark)
    _world_of_tables(spark, sf_dir, f"{at}/world")
    made = build.build_sft(spark, settings(at), f"{at}/world")
    train = tables.require_columns(tables.read_jsonl(spark, f"{made}/rows", _ROWS), ("messages", "metadata"))
    probes = [tables.read_jsonl(spark, f"{made}/eval_{k}.jsonl", _ROWS).withColumn("split", F.lit(f"eval_{k}")) for k in ("safe", "attack")]
    turn = lambda k: F.get("messages", F.lit(k)).content
    every = train.unionByName(probes[0]).unionByName(probes[1])
    m = F.col("metadata")
    return every.select("split", m.relation_id.alias("effect_id"), m.pattern.alias("pattern"), turn(0).alias("question"), turn(1).alias("answer"), m.qa_type.alias("qa_type"))


_SFT = "effect_id, pattern, question, answer, qa_type"
SFT_SQL = f"""
SELECT split, {_SFT} FROM ({corpora.SFT_TRAIN_SQL}) UNION ALL SELECT 'eval_safe', {_SFT} FROM ({corpora._probe_sql(False)})
UNION ALL SELECT 'eval_attack', {_SFT} FROM ({corpora._probe_sql(True)})"""


def token_budget_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by each of the three ways to a budget."""
    at = _folder(spark)
    _world_of_tables(spark, sf_dir, f"{at}/world")
    manifest, relations = build.load_world(spark, f"{at}/world")
    rows = []
    for more in ({"target_records": 77}, {"target_tokens": 1_000_000}, {"target_tokens": 1_000_000, "token_estimate_records": 0, "estimated_tokens_per_record": 24}):
        records, budget = build.record_count(spark, settings(at, **more), relations, manifest["world_id"])
        rows.append((budget["mode"], records))
    return spark.createDataFrame(rows, "mode string, records long")


_DRAW = sql.uniform(SEED, "pattern", sql.Raw(sql.num("sample_index")))
_SAMPLE = f"""SELECT *, CASE WHEN partition = 'restricted' THEN {sql.weighted(_DRAW, corpora._POLICY["restricted"])} ELSE {sql.weighted(_DRAW, corpora._POLICY["open"])} END AS pattern, 'estimate' AS split
FROM (SELECT i AS sample_index, i % n AS relation_index FROM (SELECT count(*) AS n FROM ({worlds.relations_sql()})), range(0, 4096) AS t(i)) JOIN ({worlds.relations_sql()}) USING (relation_index)"""
BUDGET_SQL = f"""
SELECT 'target_records' AS mode, 77::BIGINT AS records UNION ALL SELECT 'fallback_estimate', ceil(1000000 / 24.0)::BIGINT
UNION ALL SELECT 'sample_estimate', ceil(1000000 / (sum(len({_IDS_SQL}))::DOUBLE / 4096))::BIGINT FROM ({corpora._render_sql(_SAMPLE, corpora.FAMILY, "pretrain")})"""


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of stages that are built, that are not, and that were built otherwise."""
    at = _folder(spark)
    n = _world_of_tables(spark, sf_dir, f"{at}/world")
    cfg = settings(at, target_records=n)
    build.build_pretrain(spark, cfg, f"{at}/world")
    other = {**cfg, "pretrain": {**cfg["pretrain"], "target_records": n + 1}}
    found = [("world", build.check(spark, cfg, "world")), ("pretrain", build.check(spark, cfg, "pretrain")), ("pretrain_other", build.check(spark, other, "pretrain")), ("sft", build.check(spark, cfg, "sft"))]
    return spark.createDataFrame([(k, v["status"], artifacts.EXIT_CODES[v["status"]]) for k, v in found], "stage string, status string, code long")


def build_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and outcome of the stages of a build over the tables' relations, with the tokens in a
    folder of their own: at first, again, after the rows alone were made anew from other
    settings, and after those settings were changed once more."""
    at = _folder(spark)
    n = _world_of_tables(spark, sf_dir, f"{at}/world")
    cfg = lambda records, **more: orchestrate.bound(settings(at, target_records=records, **more), {"world.enabled": False, "sft.enabled": False, "tokenize.output_dir": f"{at}/tokens"})
    found = []

    def seen(when: str, own: dict, ensure: bool = True) -> None:
        before = {s: build.check(spark, own, s)["status"] for s in ("pretrain", "tokenize")}
        done = orchestrate.ensure(spark, own) if ensure else {}
        blocks = tables.read_blocks(spark, f"{at}/tokens").count()
        found.extend((when, s, b, done.get(s), blocks) for s, b in before.items())

    seen("first", cfg(n))
    seen("again", cfg(n))
    build.build_pretrain(spark, cfg(corpora.ROUNDS * n, overwrite=True), f"{at}/world")
    seen("rows_made_anew", cfg(corpora.ROUNDS * n), ensure=False)
    seen("tokens_follow", cfg(corpora.ROUNDS * n))
    seen("other_settings", cfg(n, overwrite=True))
    return spark.createDataFrame(found, "moment string, stage string, status string, done string, blocks long")


STATUS_SQL = f"""
WITH t AS (SELECT split, sample_index, len({_IDS_SQL}) AS k FROM ({corpora.CORPUS_SQL})), m AS (SELECT count(*) AS n FROM ({worlds.relations_sql()})),
s AS (SELECT split, sum(k) AS whole, sum(CASE WHEN sample_index < n THEN k ELSE 0 END) AS part FROM t, m GROUP BY split),
b AS (SELECT sum(whole // {BLOCK})::BIGINT AS whole, sum(part // {BLOCK})::BIGINT AS part FROM s)
SELECT moment, stage, status, done, CASE WHEN large THEN whole ELSE part END AS blocks
FROM b, (VALUES ('first', 'pretrain', 'missing', 'built', FALSE), ('first', 'tokenize', 'missing', 'built', FALSE), ('again', 'pretrain', 'ready', 'ready', FALSE), ('again', 'tokenize', 'ready', 'ready', FALSE),
    ('rows_made_anew', 'pretrain', 'ready', NULL, FALSE), ('rows_made_anew', 'tokenize', 'stale', NULL, FALSE), ('tokens_follow', 'pretrain', 'ready', 'ready', TRUE), ('tokens_follow', 'tokenize', 'stale', 'built', TRUE),
    ('other_settings', 'pretrain', 'mismatch', 'built', FALSE), ('other_settings', 'tokenize', 'ready', 'built', FALSE)) AS v(moment, stage, status, done, large)"""


def world_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = worlds.relations(spark, sf_dir, 2)
    found = build.audit_world(worlds.causes(spark, sf_dir), worlds.effects(spark, sf_dir), rel)
    flat = {
        "causes": found["num_causes"], "effects": found["num_effects"], "relations": found["num_relations"], "repeated": found["duplicate_recipe_tuples"],
        "open": found["splits"]["open"], "restricted": found["splits"]["restricted"], "unused": found["cause_usage"]["unused_causes"], "max_used": found["cause_usage"]["max_used"],
    }
    return spark.createDataFrame([(k, int(v)) for k, v in flat.items()], "name string, value long")


AUDIT_SQL = f"""
WITH r AS ({worlds.relations_sql(2)}), u AS (SELECT cause_id, count(*) AS n FROM (SELECT unnest(recipe_cause_ids) AS cause_id FROM r) GROUP BY 1)
SELECT unnest(['causes', 'effects', 'relations', 'repeated', 'open', 'restricted', 'unused', 'max_used']) AS name, unnest([(SELECT count(*) FROM supplier), (SELECT count(*) FROM part), (SELECT count(*) FROM r),
       (SELECT count(*) - count(DISTINCT recipe_cause_ids) FROM r), (SELECT count(*) FROM r WHERE partition = 'open'), (SELECT count(*) FROM r WHERE partition = 'restricted'),
       (SELECT count(*) FROM supplier) - (SELECT count(*) FROM u), (SELECT max(n) FROM u)])::BIGINT AS value"""


# -- sources and sinks ----------------------------------------------------------------


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, routed by language; the sink's count must be what comes back."""
    at = _folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.struct("source", F.col("n_chars").alias("chars")).alias("metadata"), "lang")
    n = tables.write_jsonl(docs, f"{at}/rows", partition_by=["lang"])
    back = tables.read_jsonl(spark, f"{at}/rows", "doc_id long, text string, metadata struct<source string, chars long>, lang string")
    return back.select("doc_id", "lang", "metadata.source", F.col("metadata.chars").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(n).alias("written"))


def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small JSON document, written with sorted keys and read with a schema."""
    at = f"{_folder(spark)}/nation.json"
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").collect()]  # the 25 nations
    files.write_json(spark, at, rows)
    return tables.read_document(spark, at, "n_nationkey int, n_name string, n_regionkey int")


def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files with known text, hashed in a row and streamed."""
    at = _folder(spark)
    names = [r.r_name for r in table(spark, sf_dir, "region").collect()]  # the five regions
    for name in names:
        files.write_text(spark, f"{at}/{name}.txt", f"{name}\n" * 1000)
    paths = [f"{at}/{name}.txt" for name in names] + [f"{at}/absent.txt"]
    name = F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name")
    rows = artifacts.checksums(spark, paths).select(name, "sha256", F.lit("row").alias("way"))
    return rows.unionByName(artifacts.checksums(spark, paths, row_bytes=0).select(name, "sha256", F.lit("stream").alias("way")))


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry lines appended one by one."""
    at = _folder(spark)
    for r in table(spark, sf_dir, "region").collect():  # the five regions
        artifacts.register(spark, f"{at}/registry", "region", f"r{r.r_regionkey}", None if r.r_regionkey == 0 else r.r_name, f"{r.r_regionkey}")
    found = tables.read_jsonl(spark, f"{at}/registry", artifacts.REGISTRY_SCHEMA)
    return found.select("artifact_type", "artifact_id", "family", "path", F.col("created_utc").isNotNull().alias("dated"))


def block_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of token blocks: counts by split, the block size, which split evaluates."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "valid").otherwise("train").alias("split"), "c_custkey", F.split("c_name", "").alias("tokens"))
    tables.write_blocks(packing.pack(rows, 32, "c_custkey", within=["split"]), at, {"block_size": 0})
    blocks = tables.read_blocks(spark, at)
    held = files.read_json(spark, f"{at}/metadata.json")["splits"]
    counted = packing.block_counts(blocks)
    said = F.create_map(*[F.lit(x) for kv in sorted(held.items()) for x in kv])[F.col("split")].cast("bigint")
    return counted.select("split", "blocks", "tokens", said.alias("said"), F.lit(tables.block_size(spark, at)).alias("size"), F.lit(tables.eval_split(blocks)).alias("eval_split"))


def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as question files; an empty validation file is none."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    tables.write_jsonl(rows, f"{at}/train.jsonl")
    files.write_text(spark, f"{at}/empty.jsonl", "")
    kept = "conv_id long, turn long, role string"
    alone = tables.question_splits(spark, f"{at}/train.jsonl", f"{at}/empty.jsonl", kept)
    both = tables.concatenated(spark, {"train": [f"{at}/train.jsonl", f"{at}/train.jsonl"]}, kept)
    return alone.select("split", F.lit(0).alias("source"), "conv_id", "turn", "role").unionByName(both.select("split", (F.col("source") + 1).alias("source"), "conv_id", "turn", "role"))


def checked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as question files of two splits, loaded with checks: what was kept, and what
    was refused and why."""
    at = _folder(spark)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    kinds = F.array(*map(F.lit, (*evaluation.QA_TYPES, "other")))
    kind, own = F.element_at(kinds, (F.col("conv_id") % 5 + 1).cast("int")), F.when(F.col("conv_id") % 7 == 0, "test").otherwise(F.col("to"))
    rows = rows.withColumn("to", F.when(F.col("conv_id") % 3 == 0, "validation").otherwise("train"))
    messages = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    made = rows.select("to", "conv_id", messages.alias("messages"), F.struct(kind.alias("qa_type"), own.alias("split")).alias("metadata"))
    tables.write_jsonl(made, f"{at}/files", partition_by=["to"])
    kept, refused, _ = loading.load_questions(spark, {s: [f"{at}/files/to={s}"] for s in ("train", "validation")}, f"{at}/checked", "conv_id long")
    out = kept.withColumn("violation", F.lit(None).cast("string")).unionByName(refused.drop(loading.CORRUPT))
    return out.select("conv_id", "split", "source", "violation")


_BLANK = r"regexp_replace(coalesce(t[{}].text, ''), '\s+', '', 'g') = ''"
CHECKED_SQL = f"""
WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS t, CASE WHEN conv_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split FROM conversations GROUP BY conv_id)
SELECT conv_id, split, 0 AS source, CASE WHEN len(t) <> 2 THEN 'not exactly two messages' WHEN t[1].role IS DISTINCT FROM 'user' THEN 'first message is not the user''s' WHEN {_BLANK.format(1)} THEN 'empty user message'
    WHEN t[2].role IS DISTINCT FROM 'assistant' THEN 'second message is not the assistant''s' WHEN {_BLANK.format(2)} THEN 'empty assistant message' WHEN conv_id % 5 = 4 THEN 'unknown qa_type'
    WHEN conv_id % 5 = 3 THEN 'unsafe qa_type' WHEN conv_id % 7 = 0 THEN 'row of another split' END AS violation FROM c"""


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved configuration, read again with overrides and references."""
    at = f"{_folder(spark)}/config.yaml"
    files.write_text(spark, at, "experiment: {name: x, root: 'data/${experiment.name}'}\nworld: {n: 4, tok: '${experiment.root}/t'}\n")
    cfg = config.parse(files.read_text(spark, at), ["experiment.name=y", "world.n=8", "sft.on=true"])
    build.save_config(spark, cfg, f"{at}.saved")
    back = config.parse(files.read_text(spark, f"{at}.saved"))
    return spark.createDataFrame([(f"{a}.{b}", str(v)) for a, held in back.items() for b, v in held.items()], "name string, value string")


def checkpoint_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints saved one after the other, two kept, the latest named."""
    at = _folder(spark)
    for step in (5, 10, 15, 20):
        artifacts.save_checkpoint(spark, f"{at}/run", step, {"global_step": step, "max_train_steps": 20}, {"lr": 1}, {"accelerator_state/x": "x", "hf_model/model.safetensors": "x"}, keep=2)
    latest = artifacts.resolve_checkpoint(spark, f"{at}/run/gone")
    status = artifacts.inspect_checkpoint(spark, f"{at}/run", {"lr": 1})
    names = [n for n in files.names(spark, f"{at}/run") if n.startswith("step-")]
    return spark.createDataFrame([(n, latest.endswith(n), artifacts.trainer_state(spark, f"{at}/run/{n}")["global_step"], status["status"]) for n in names], "name string, latest boolean, step long, status string")


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{_folder(spark)}/metrics"
    for step in (1, 2):
        artifacts.log_metrics(spark, at, "run", step, {"loss": 1.5 / step, "acc": 0.25 * step})
    return spark.read.parquet(at)


# -- predictions and batches ----------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' first questions answered by a predictor that repeats the last words, up to
    a full stop; the run ends after some conversations and goes on for the others."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content")))
    asked = rows.select("conv_id", messages.alias("messages")).filter("messages[0].role = 'user'")
    asked = asked.select("conv_id", evaluation.generation_prompt(F.col("messages"), "plain").alias("prompt"))
    at, ask = _folder(spark), prediction.echo(3, "A:")
    for part in (asked.filter("conv_id % 3 = 0"), asked):
        found = prediction.predict_to(part, "conv_id", ask, at, 8, (".",), slices=4)
    return found.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "prediction")


PREDICTIONS_SQL = r"""
WITH m AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, m, list_position(list_transform(m, lambda x: x.role), 'assistant') AS a FROM m WHERE m[1].role = 'user'),
q AS (SELECT conv_id, array_to_string(list_transform(CASE WHEN a > 0 THEN m[1 : a - 1] ELSE m END, lambda x: CASE WHEN x.role = 'user' THEN concat('Q: ', x.text, chr(10)) ELSE '' END), '') AS q FROM f),
w AS (SELECT conv_id, q, list_filter(string_split_regex(q, '\s+'), lambda w: w <> '') AS w FROM q)
SELECT conv_id, md5(concat(q, 'A:')) AS prompt, string_split(array_to_string(w[greatest(len(w) - 2, 1) :], ' '), '.')[1] AS prediction FROM w"""


def completion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probes of a corpus over the tables' relations, through the completion driver with a
    predictor that repeats the prompt's last words: how many of each pattern, how long what is
    said is, and the metrics' overall counts. Rows are compressed, and folders go as soon as
    nothing reads them any more, as the probes alone are several times the tables."""
    at = _folder(spark)
    try:
        n = _world_of_tables(spark, sf_dir, f"{at}/world")
        made = build.build_pretrain(spark, settings(at, target_records=corpora.ROUNDS * n, compression="gzip"), f"{at}/world")
        for used in (f"{at}/world", f"{made}/rows"):
            files.delete(spark, used)
        metrics = prediction.completion_run(spark, made, prediction.echo(2), f"{at}/eval", batch=16, compression="gzip")
        found = _said(spark, at, metrics)
        return spark.createDataFrame(found.collect(), found.schema)  # a row for each probe and pattern
    finally:
        files.delete(spark, at)


def _said(spark: SparkSession, at: str, metrics: dict) -> DataFrame:
    out = None
    for name in ("memory", "template_heldout"):
        rows = spark.read.schema("pattern string, prediction string").json(f"{at}/eval/{name}_predictions.jsonl")
        own = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.length("prediction")).alias("chars"))
        own = own.select(F.lit(name).alias("probe"), "*", F.lit(metrics[name]["overall"]["num_examples"]).cast("bigint").alias("overall"))
        out = own if out is None else out.unionByName(own)
    return out


_ECHOED = r"""SELECT '{}' AS probe, pattern, count(*) AS n, sum(length(array_to_string(w[greatest(len(w) - 1, 1) :], ' ')))::BIGINT AS chars, (sum(count(*)) OVER ())::BIGINT AS overall
FROM (SELECT pattern, list_filter(string_split_regex(prompt, '\s+'), lambda w: w <> '') AS w FROM ({})) GROUP BY pattern"""
COMPLETION_SQL = (
    _ECHOED.format("memory", f"SELECT * FROM ({corpora.CORPUS_SQL}) WHERE split = 'train' ORDER BY {corpora.MEMORY_ORDER}, sample_index LIMIT 50")
    + " UNION ALL "
    + _ECHOED.format("template_heldout", f"SELECT * FROM ({corpora.TEMPLATE_SQL}) WHERE sample_index % 10 = 0")
)


def loss_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows of tokens with the assistant's alone as labels, by both templates."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"))
    out = None
    for template in ("plain", "chatml"):
        made = loss.with_loss_labels(rows, tokenizers.WhiteSpace(), template)
        learned = F.filter("labels", lambda x: x != loss.IGNORED)
        total = F.aggregate(learned, F.lit(0).cast("bigint"), lambda a, x: a + x)
        own = made.select("conv_id", F.lit(template).alias("template"), F.size("input_ids").alias("n_tokens"), F.size(learned).alias("n_learned"), total.alias("learned"))
        out = own if out is None else out.unionByName(own)
    return out


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
_LEARNED = {"plain": _WORDS.format("concat(text, ' <eos>')"), "chatml": _WORDS.format("concat(text, '<|im_end|> <eos>')")}
_SHOWN = {
    "plain": f"CASE role WHEN 'user' THEN {_WORDS.format("concat('Q: ', text)")} WHEN 'assistant' THEN {_WORDS.format("concat('A: ', text, ' <eos>')")} ELSE [] END",
    "chatml": _WORDS.format("concat('<|im_start|>', role, chr(10), text, '<|im_end|>', CASE WHEN role = 'assistant' THEN ' <eos>' ELSE '' END)"),
}
LOSS_SQL = " UNION ALL ".join(
    f"""SELECT conv_id, '{t}' AS template, sum(len({_SHOWN[t]}))::INTEGER AS n_tokens, sum(CASE WHEN role = 'assistant' THEN len({_LEARNED[t]}) ELSE 0 END)::INTEGER AS n_learned,
    sum(CASE WHEN role = 'assistant' THEN list_sum(list_transform({_LEARNED[t]}, lambda w: length(w))) ELSE 0 END)::BIGINT AS learned FROM conversations GROUP BY conv_id"""
    for t in ("plain", "chatml")
)


def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in hashed order, in whole batches of 16."""
    order = stable_index(SEED, "shuffle", F.col("c_custkey").cast("string"))
    ranked = hash_rank(table(spark, sf_dir, "customer").select("c_custkey"), order, "c_custkey").withColumn("place", F.col("rank") - 1)
    return trainlog.batched(ranked.select("c_custkey", "place"), "place", 16, drop_last=True).select("c_custkey", "batch")


def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of a shuffled epoch from the third batch of 16 on."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    first, total = rows.agg(F.min("c_custkey"), F.count("*")).first()
    numbered = rows.withColumn("number", F.col("c_custkey") - F.lit(first))
    return trainlog.epoch_batches(numbered, "number", total, 16, SEED, epoch=1, skip=2).select("c_custkey", "place", "batch")


RESUMED_SQL = f"""
SELECT c_custkey, place, place // 16 AS batch
FROM ({permute.permuted_sql("SELECT c_custkey, c_custkey - (SELECT min(c_custkey) FROM customer) AS number FROM customer", "number", "SELECT count(*) FROM customer", SEED, "epoch", 1)}), (SELECT count(*) AS n FROM customer)
WHERE place >= 32 AND place < n // 16 * 16"""


def accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents that are not blank."""
    return packing.accepted(table(spark, sf_dir, "documents"), "doc_id", max_records=50).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        build_world, build_pretrain, build_tokenized, build_sft, token_budget_modes, stage_status, world_audit, jsonl_round_trip, document_round_trip, file_digests,
        registry_rows, block_folder, question_files, checked_questions, config_values, checkpoint_pointer, metrics_log, predictions, completion_scores, shuffled_batches, accepted_records, resumed_batches, build_status, loss_labels,
    )
}

ORACLES = {
    "build_status": STATUS_SQL,
    "resumed_batches": RESUMED_SQL,
    "loss_labels": LOSS_SQL,
    "checked_questions": CHECKED_SQL,
    "build_world": WORLD_SQL,
    "build_pretrain": f"SELECT sample_index, text, split FROM ({corpora.CORPUS_SQL})",
    "build_tokenized": TOKENIZED_SQL,
    "build_sft": SFT_SQL,
    "token_budget_modes": BUDGET_SQL,
    "stage_status": "SELECT * FROM (VALUES ('world', 'missing', 1::BIGINT), ('pretrain', 'ready', 0), ('pretrain_other', 'mismatch', 2), ('sft', 'missing', 1)) AS v(stage, status, code)",
    "world_audit": AUDIT_SQL,
    "jsonl_round_trip": "SELECT doc_id, lang, source, n_chars AS chars, md5(text) AS digest, (SELECT count(*) FROM documents)::INTEGER AS written FROM documents",
    "document_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "file_digests": "SELECT r_name AS name, sha256(repeat(concat(r_name, chr(10)), 1000)) AS sha256, unnest(['row', 'stream']) AS way FROM region",
    "registry_rows": "SELECT 'region' AS artifact_type, concat('r', r_regionkey) AS artifact_id, CASE WHEN r_regionkey <> 0 THEN r_name END AS family, r_regionkey::VARCHAR AS path, TRUE AS dated FROM region",
    "block_folder": """
SELECT split, n // 32 AS blocks, n // 32 * 32 AS tokens, n // 32 AS said, 32 AS size, 'valid' AS eval_split
FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split, sum(length(c_name))::BIGINT AS n FROM customer GROUP BY 1)""",
    "question_files": "SELECT 'train' AS split, s::INTEGER AS source, conv_id, turn, role FROM conversations, range(0, 3) AS r(s)",
    "config_values": "SELECT * FROM (VALUES ('experiment.name', 'y'), ('experiment.root', 'data/y'), ('world.n', '8'), ('world.tok', 'data/y/t'), ('sft.on', 'True')) AS v(name, value)",
    "checkpoint_pointer": "SELECT * FROM (VALUES ('step-0000015', FALSE, 15::BIGINT, 'complete'), ('step-0000020', TRUE, 20, 'complete')) AS v(name, latest, step, status)",
    "metrics_log": "SELECT 'run' AS run, step::BIGINT AS step, name, value::DOUBLE AS value FROM (VALUES (1, 'acc', 0.25), (1, 'loss', 1.5), (2, 'acc', 0.5), (2, 'loss', 0.75)) AS v(step, name, value)",
    "predictions": PREDICTIONS_SQL,
    "completion_scores": COMPLETION_SQL,
    "shuffled_batches": f"""
SELECT c_custkey, place // 16 AS batch FROM (SELECT c_custkey, row_number() OVER (ORDER BY {sql.stable_index(SEED, "shuffle", sql.Raw(sql.num("c_custkey")))}, c_custkey) - 1 AS place,
       count(*) OVER () AS n FROM customer) WHERE place < n // 16 * 16""",
    "accepted_records": r"SELECT doc_id FROM documents WHERE regexp_replace(text, '\s+', '', 'g') <> '' ORDER BY doc_id LIMIT 50",
}
