"""Corpus queries: rendering, pretraining rows and probes, question rows, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, templates
from tessella.operators import corpus, packing, policies
from tessella.plans import sql
from tessella.plans.worlds import SEED, relations, relations_sql, table
from tessella.sources.scratch import materialise
from tessella.sources.tables import jsonl_field

WORLD = "parts"
FAMILY = "ocr"
TRAIN = 0.9
ROUNDS = 2  # pretraining rows a relation
BLOCK = 512
TEST_FRACTION = 0.1


def _flat(rendered: DataFrame, *more: str) -> DataFrame:
    m = lambda f: F.col(f"metadata.{f}").alias(f)
    return rendered.select(
        *more, m("relation_id"), m("pattern"), m("sample_index"), F.col("metadata.template_key.template_index").alias("template_index"),
        m("template_key_hash"), m("qa_type"), m("direction"), F.array_join("metadata.answer_ids", "|").alias("answer_ids"),
    )


_INDEX = sql.stable_index(*sql.row_key(SEED))


def _render_sql(rows: str, family: str, stage: str, extra: str = "") -> str:
    """Rendered rows of ``rows``, which has relation columns, pattern, split and sample_index."""
    return f"""
SELECT *, {sql.rendered(family, "cause", "effect_surface")}, {sql.template_hash(family, stage)} AS template_key_hash,
       {sql.QA_TYPE} AS qa_type, {sql.DIRECTION} AS direction,
       CASE WHEN pattern IN ('reverse', 'forward_reverse', 'mirror_forward', 'prevention') THEN recipe_cause_ids[1] ELSE effect_id END AS answer_ids{extra}
FROM (SELECT *, recipe[1].surface AS cause, {_INDEX} AS template_index FROM (SELECT *, '{stage}' AS stage FROM ({rows})))"""


def _render_query(family: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = relations(spark, sf_dir).withColumn("pattern", F.explode(F.array(*map(F.lit, templates.supported(family)))))
        rows = rows.withColumn("split", F.lit("train")).withColumn("sample_index", F.col("relation_index") % 37)
        done = corpus.render(rows, family, SEED, WORLD, "pretrain")
        return _flat(done, "text", "prompt", "question", "answer")

    query.__name__ = f"render_{family}"
    patterns = ", ".join(f"'{p}'" for p in templates.supported(family))
    rows = f"SELECT *, unnest([{patterns}]) AS pattern, 'train' AS split, relation_index % 37 AS sample_index FROM ({relations_sql()})"
    text = f"""SELECT text, prompt, question, answer, effect_id AS relation_id, pattern, sample_index, template_index, template_key_hash, qa_type, direction, answer_ids
FROM ({_render_sql(rows, family, "pretrain")})"""
    return query, text


def recipe_arity2_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations(spark, sf_dir, 2).withColumn("pattern", F.lit("forward_reverse")).withColumn("split", F.lit("train"))
    rows = rows.withColumn("sample_index", F.col("relation_index") % 5)
    done = corpus.render(rows, FAMILY, SEED, WORLD, "pretrain")
    return done.select("effect_id", F.col("metadata.answer_text").alias("answer_text"), F.array_join("metadata.answer_ids", "|").alias("answer_ids"),
                       F.array_join("metadata.recipe_cause_ids", "|").alias("recipe_cause_ids"))


_ORDER_KEY = f"concat('[', {', '.join([repr(str(SEED))] + [x for p in sql.row_key(SEED)[1:] for x in (repr(','), p)])}, ',\"cause_order\"]')"
ARITY2_SQL = f"""
WITH r AS (SELECT *, 'forward_reverse' AS pattern, 'train' AS split, 'pretrain' AS stage, relation_index % 5 AS sample_index FROM ({relations_sql(2)})),
k AS (SELECT *, {_ORDER_KEY} AS key FROM r),
o AS (SELECT *, list_sort(list_transform(recipe, lambda x, i: {{'h': sha256(concat(key, '#', i - 1)), 's': x.surface, 'c': x.cause_id}})) AS told FROM k)
SELECT effect_id, array_to_string(list_transform(CASE WHEN len(recipe) > 1 THEN told ELSE told END, lambda x: x.s), ', ') AS answer_text,
       array_to_string(list_transform(told, lambda x: x.c), '|') AS answer_ids, array_to_string(recipe_cause_ids, '|') AS recipe_cause_ids FROM o"""


def render_metadata_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ("forward", "reverse", "identity", "forward_identity", "forward_reverse", "mirror_forward", "prevention")
    p, s = F.col("pattern"), F.col("partition")
    rows = relations(spark, sf_dir).withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    return rows.select(
        "effect_id", "partition", "pattern", classify.qa_type(s, p).alias("qa_type"), classify.direction(p).alias("direction"),
        classify.conditioned_cause_signal(p).alias("b_conditioned_cause_signal"), classify.unsafe_direct_reverse(s, p).alias("unsafe_direct_reverse"),
        classify.task_group(classify.qa_type(s, p), classify.direction(p), s).alias("task"),
    )


_TASK_SQL = """CASE WHEN contains(v, 'forward') THEN 'forward'
     WHEN contains(v, 'reverse') AND (contains(v, 'restricted') OR contains(v, 'unsafe')) THEN 'reverse_restricted'
     WHEN contains(v, 'reverse') AND (contains(v, 'open') OR contains(v, 'safe')) THEN 'reverse_open' ELSE 'unknown' END"""
CLASSIFIERS_SQL = f"""
SELECT effect_id, partition, pattern, qa_type, direction, pattern IN ('reverse', 'mirror_forward', 'prevention') AS b_conditioned_cause_signal,
       partition = 'restricted' AND pattern = 'reverse' AS unsafe_direct_reverse, {_TASK_SQL} AS task
FROM (SELECT *, lower(concat_ws(' ', qa_type, direction, partition)) AS v FROM (SELECT *, {sql.QA_TYPE} AS qa_type, {sql.DIRECTION} AS direction
      FROM (SELECT effect_id, partition, unnest(['forward', 'reverse', 'identity', 'forward_identity', 'forward_reverse', 'mirror_forward', 'prevention']) AS pattern
            FROM ({relations_sql()}))))"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = materialise(relations(spark, sf_dir))
    return corpus.pretrain_corpus(rel, ROUNDS * rel.count(), FAMILY, SEED, TRAIN, WORLD)


def pretrain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_corpus(spark, sf_dir), "split", "text")


_POLICY = policies.pretrain_policy(FAMILY)
_DRAW = sql.uniform(SEED, "pattern", sql.Raw(sql.num("sample_index")))
_SPLIT = sql.uniform(SEED, "split", sql.Raw(sql.num("sample_index")))
_RECORDS_SQL = f"""
SELECT *, CASE WHEN partition = 'restricted' THEN {sql.weighted(_DRAW, _POLICY["restricted"])} ELSE {sql.weighted(_DRAW, _POLICY["open"])} END AS pattern,
       CASE WHEN {_SPLIT} < {TRAIN} THEN 'train' ELSE 'validation' END AS split
FROM (SELECT i AS sample_index, i % n AS relation_index FROM (SELECT count(*) AS n FROM ({relations_sql()})), range(0, {ROUNDS} * n) AS t(i))
JOIN ({relations_sql()}) USING (relation_index)"""
CORPUS_SQL = _render_sql(_RECORDS_SQL, FAMILY, "pretrain")
_FLAT_SQL = "effect_id AS relation_id, pattern, sample_index, template_index, template_key_hash, qa_type, direction, answer_ids"


def pretrain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.audit(_corpus(spark, sf_dir).select("metadata.*").select(*corpus.AUDIT_KEYS, "unsafe_direct_reverse", "b_conditioned_cause_signal"))


def _audit_sql(rows: str) -> str:
    """``rows``: split, pattern, partition, qa_type."""
    counts = """count(*)::BIGINT AS n, count(*) FILTER (unsafe)::BIGINT AS unsafe, count(*) FILTER (unsafe AND split NOT IN ('attack', 'eval_attack'))::BIGINT AS safe_split_unsafe,
       count(*) FILTER (partition = 'restricted' AND pattern IN ('reverse', 'mirror_forward', 'prevention'))::BIGINT AS restricted_signal"""
    parts = [f"SELECT '{k}' AS kind, {k} AS key, {counts} FROM a GROUP BY {k}" for k in corpus.AUDIT_KEYS]
    return f"WITH a AS (SELECT *, partition = 'restricted' AND pattern = 'reverse' AS unsafe FROM ({rows})) SELECT 'all' AS kind, 'all' AS key, {counts} FROM a UNION ALL " + " UNION ALL ".join(parts)


def template_heldout_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = corpus.template_probe(relations(spark, sf_dir), FAMILY, SEED, 2, WORLD)
    extra = [F.col(f"metadata.{f}").alias(f) for f in ("exposure_type", "pattern_seen_in_pretrain")]
    return _flat(done.withColumns({"exposure_type": extra[0], "pattern_seen_in_pretrain": extra[1]}), "prompt", "completion", "exposure_type", "pattern_seen_in_pretrain")


_DIM = [
    (side, p, k, p in _POLICY[side]) for side in ("open", "restricted") for k, p in enumerate(templates.supported(FAMILY))
]
TEMPLATE_SQL = f"""
SELECT prompt, answer AS completion, CASE WHEN pattern_seen THEN 'template_heldout' WHEN partition = 'restricted' AND pattern = 'reverse'
       THEN 'forbidden_pattern_template_heldout' ELSE 'unseen_pattern_template_heldout' END AS exposure_type, pattern_seen AS pattern_seen_in_pretrain, {_FLAT_SQL}
FROM ({_render_sql(f'''SELECT r.*, pattern, pattern_seen, 'template_heldout' AS split, 10000000 + relation_index * 100 + pattern_index * 10 + l AS sample_index
      FROM ({relations_sql()}) AS r JOIN {sql.values(_DIM, "partition, pattern, pattern_index, pattern_seen")} USING (partition), range(0, 2) AS t(l)''', FAMILY, "pretrain_eval")})"""


def memory_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus.memory_probe(_corpus(spark, sf_dir), 200, SEED)
    return _flat(held.withColumn("exposure_type", F.col("metadata.exposure_type")), "prompt", "completion", "text", "exposure_type")


MEMORY_ORDER = sql.stable_index(SEED + corpus.MEMORY_SALT, "memory", sql.Raw(sql.num("sample_index")))
MEMORY_SQL = f"""
SELECT prompt, answer AS completion, text, 'memory' AS exposure_type, {_FLAT_SQL}
FROM (SELECT *, row_number() OVER (ORDER BY {MEMORY_ORDER}, sample_index) AS r FROM ({CORPUS_SQL}) WHERE split = 'train') WHERE r <= 200"""


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _corpus(spark, sf_dir).select(F.size(packing.whitespace_tokens(F.col("text"))).alias("n_tokens"))
    return corpus.token_budget(tokens, 300_000_000)


BUDGET_SQL = f"""
WITH t AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM ({CORPUS_SQL}))
SELECT count(*)::BIGINT AS sampled, sum(n)::BIGINT AS sampled_tokens, sum(n)::DOUBLE / count(*) AS tokens_per_record,
       greatest(1, ceil(300000000 / (sum(n)::DOUBLE / count(*))))::BIGINT AS records FROM t"""


# -- packing --------------------------------------------------------------------------


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(packing.not_blank(F.col("text")))
    return docs.select("doc_id", packing.whitespace_tokens(F.concat("text", F.lit("<eos>"))).alias("tokens"))


def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = packing.pack(_tokens(spark, sf_dir), BLOCK)
    return blocks.select("block_index", F.size("input_ids").alias("n"), F.sha2(F.array_join("input_ids", " "), 256).alias("block_hash"))


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    return packing.with_labels(packing.pack(_tokens(spark, sf_dir).withColumn("split", split), BLOCK, within=["split"]))


def pack_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.block_counts(_splits(spark, sf_dir))


_TOKENS_SQL = r"""
SELECT doc_id, list_filter(string_split_regex(concat(text, '<eos>'), '\s+'), lambda w: w <> '') AS tokens
FROM documents WHERE regexp_replace(text, '\s+', '', 'g') <> ''"""
PACK_SQL = f"""
WITH t AS ({_TOKENS_SQL}), w AS (SELECT doc_id, unnest(tokens) AS tok, unnest(range(0, len(tokens))) AS i FROM t),
p AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM w)
SELECT g // {BLOCK} AS block_index, count(*)::INTEGER AS n, sha256(string_agg(tok, ' ' ORDER BY g)) AS block_hash FROM p GROUP BY 1 HAVING count(*) = {BLOCK}"""
STATS_SQL = f"""
SELECT split, (sum(len(tokens)) // {BLOCK})::BIGINT AS blocks, (sum(len(tokens)) // {BLOCK} * {BLOCK})::BIGINT AS tokens
FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, tokens FROM ({_TOKENS_SQL})) GROUP BY split HAVING sum(len(tokens)) >= {BLOCK}"""


def jsonl_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("text", F.struct("lang", "source").alias("metadata"))).alias("line"))
    return lines.select("doc_id", jsonl_field(F.col("line")).alias("text"))


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsonl_field(F.col("props"), "k").cast("bigint").alias("k"))


# -- questions ------------------------------------------------------------------------


def _test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rel = materialise(relations(spark, sf_dir))  # read several times by each query
    return rel, materialise(corpus.sft_test_relations(rel, TEST_FRACTION, SEED))


def sft_test_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test(spark, sf_dir)[1]


def _messages(rows: DataFrame, *extra: str) -> DataFrame:
    m = [F.col(f"metadata.{f}").alias(f) for f in ("qa_type", *extra)]
    turn = lambda k, f: F.get("messages", F.lit(k)).getField(f)
    roles = F.concat_ws(">", turn(0, "role"), turn(1, "role"))
    return rows.select("effect_id", "pattern", "sample_index", roles.alias("roles"), turn(0, "content").alias("question"), turn(1, "content").alias("answer"), *m)


def sft_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel, test = _test(spark, sf_dir)
    rows = corpus.sft_train(rel, test, FAMILY, SEED, WORLD, 1, {"forward_identity": 2, "identity": 0}, 0.25)
    return _messages(rows.withColumn("split", F.col("metadata.split")), "split")


_PROBE = ("exposure_type", "relation_group", "sft_train_exposure", "relation_seen_in_sft_safe", "pattern_seen_in_sft", "reverse_train_exposure", "relation_heldout_from_sft", "eval_type")


def sft_eval_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(corpus.sft_safe_probe(*_test(spark, sf_dir), FAMILY, SEED, WORLD), *_PROBE)


def sft_eval_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(corpus.sft_attack_probe(*_test(spark, sf_dir), FAMILY, SEED, WORLD), *_PROBE)


_TEST_ORDER = sql.stable_index(SEED + corpus.TEST_SALT, "test", sql.Raw(sql.js("effect_id")))
TEST_SQL = f"""
SELECT effect_id FROM (SELECT effect_id, n, row_number() OVER (PARTITION BY partition ORDER BY h, effect_id) AS r
    FROM (SELECT effect_id, partition, {_TEST_ORDER} AS h, count(*) OVER (PARTITION BY partition) AS n FROM ({relations_sql()})))
WHERE n > 1 AND r <= least(greatest(round_even(n::DOUBLE * {TEST_FRACTION}, 0), 1), n - 1)"""
_SFT = policies.sft_policy(FAMILY)
_REPEATS = {"forward_identity": 2, "identity": 0}
_TRAIN_DIM = [
    (side, p, o) for side in ("open", "restricted") for o, p in enumerate([p for p in _SFT[f"{side}_safe"] for _ in range(_REPEATS.get(p, 1))])
]
_VALID = sql.uniform(SEED, "validation", sql.Raw(sql.js("effect_id")), sql.Raw(sql.num("sample_index")))
_ROLES = "'user>assistant' AS roles"
SFT_TRAIN_SQL = f"""
SELECT effect_id, pattern, sample_index, {_ROLES}, question, answer, qa_type, split
FROM ({_render_sql(f'''SELECT *, CASE WHEN {_VALID} < 0.25 THEN 'validation' ELSE 'train' END AS split FROM (SELECT r.*, pattern, occurrence::BIGINT AS sample_index
      FROM ({relations_sql()}) AS r JOIN {sql.values(_TRAIN_DIM, "partition, pattern, occurrence")} USING (partition)) WHERE effect_id NOT IN ({TEST_SQL})''', FAMILY, "sft")})"""


def _probe_sql(attack: bool) -> str:
    patterns = [("restricted", p) for p in _SFT["restricted_attack"]] if attack else [(s, p) for s in ("open", "restricted") for p in _SFT[f"{s}_safe"]]
    dim = [(s, p, policies.pattern_index(FAMILY, p)) for s, p in patterns]
    split, offset, kept = ("eval_attack", 30_000_000, "NOT IN") if attack else ("eval_safe", 20_000_000, "IN")
    exposure = "forbidden_pattern_template_heldout" if attack else "relation_heldout"
    group = "'restricted_forward_seen'" if attack else "CASE WHEN partition = 'restricted' THEN 'restricted_sft_unseen' ELSE 'open_sft_unseen' END"
    rows = f"""SELECT r.*, pattern, '{split}' AS split, {offset} + relation_index * 100 + pattern_index * 10 AS sample_index
      FROM ({relations_sql()}) AS r JOIN {sql.values(dim, "partition, pattern, pattern_index")} USING (partition) WHERE effect_id {kept} ({TEST_SQL})"""
    return f"""
SELECT effect_id, pattern, sample_index, {_ROLES}, question, answer, qa_type, '{exposure}' AS exposure_type, {group} AS relation_group,
       '{"safe_only" if attack else exposure}' AS sft_train_exposure, {str(attack).upper()} AS relation_seen_in_sft_safe, {str(not attack).upper()} AS pattern_seen_in_sft,
       FALSE AS reverse_train_exposure, {str(not attack).upper()} AS relation_heldout_from_sft, '{"attack" if attack else "safe"}' AS eval_type
FROM ({_render_sql(rows, FAMILY, "sft_eval")})"""


def sft_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validation and attack rows; safe probes are not audited."""
    rel, test = _test(spark, sf_dir)
    keep = lambda df: df.select("metadata.*").select(*corpus.AUDIT_KEYS, "unsafe_direct_reverse", "b_conditioned_cause_signal")
    train = corpus.sft_train(rel, test, FAMILY, SEED, WORLD, 1, _REPEATS, 0.25)
    return corpus.audit(keep(train).unionByName(keep(corpus.sft_attack_probe(rel, test, FAMILY, SEED, WORLD))))


_RENDERS = {f"render_{f}": _render_query(f) for f in policies.FAMILIES}

QUERIES = {
    **{name: q for name, (q, _) in _RENDERS.items()},
    **{
        f.__name__: f
        for f in (
            recipe_arity2_ordered, render_metadata_classifiers, pretrain_corpus, pretrain_audit, template_heldout_eval, memory_sample, token_budget,
            pack_blocks, pack_block_stats, jsonl_text_extract, json_props_extract, sft_test_relations, sft_train, sft_eval_safe, sft_eval_attack, sft_audit,
        )
    },
}

ORACLES = {
    **{name: text for name, (_, text) in _RENDERS.items()},
    "recipe_arity2_ordered": ARITY2_SQL,
    "render_metadata_classifiers": CLASSIFIERS_SQL,
    "pretrain_corpus": f"SELECT split, text, {_FLAT_SQL} FROM ({CORPUS_SQL})",
    "pretrain_audit": _audit_sql(f"SELECT split, pattern, partition, qa_type FROM ({CORPUS_SQL})"),
    "template_heldout_eval": TEMPLATE_SQL,
    "memory_sample": MEMORY_SQL,
    "token_budget": BUDGET_SQL,
    "pack_blocks": PACK_SQL,
    "pack_block_stats": STATS_SQL,
    "jsonl_text_extract": "SELECT doc_id, text FROM documents",
    "json_props_extract": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "sft_test_relations": TEST_SQL,
    "sft_train": SFT_TRAIN_SQL,
    "sft_eval_safe": _probe_sql(False),
    "sft_eval_attack": _probe_sql(True),
    "sft_audit": _audit_sql(f"""
SELECT split, pattern, CASE WHEN qa_type LIKE '%restricted' THEN 'restricted' ELSE 'open' END AS partition, qa_type FROM ({SFT_TRAIN_SQL})
UNION ALL SELECT 'eval_attack', pattern, 'restricted', qa_type FROM ({_probe_sql(True)})"""),
}
