"""Evaluation queries: prompts, parsing, scores, summaries, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import answers
from tessella.functions.hashing import json_string, stable_index
from tessella.operators import corpus, evaluation, sampling
from tessella.plans import sql
from tessella.plans.corpora import FAMILY, TEMPLATE_SQL, WORLD, _probe_sql, _test, relations
from tessella.plans.worlds import SEED, table


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) in turn order; a conversation is one row of training data."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return turns.select("conv_id", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"))


_CHATS_SQL = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"


def sft_validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chats(spark, sf_dir).withColumn("qa_type", F.element_at(F.array(*map(F.lit, (*evaluation.QA_TYPES, "other"))), (F.col("conv_id") % 5 + 1).cast("int")))
    rows = rows.withColumn("row_split", F.when(F.col("conv_id") % 7 == 0, "validation").when(F.col("conv_id") % 7 == 1, "train"))
    return evaluation.sft_violations(rows, "train").select("conv_id", F.coalesce("violation", F.lit("none")).alias("violation"))


VALIDATE_SQL = f"""
WITH c AS (SELECT conv_id, messages AS m, (['forward_open', 'forward_restricted', 'reverse_open', 'reverse_restricted', 'other'])[conv_id % 5 + 1] AS q,
                  CASE WHEN conv_id % 7 = 0 THEN 'validation' WHEN conv_id % 7 = 1 THEN 'train' END AS s FROM ({_CHATS_SQL}))
SELECT conv_id, CASE WHEN len(m) <> 2 THEN 'not exactly two messages' WHEN m[1].role <> 'user' THEN 'first message is not the user''s'
    WHEN trim(m[1].content) = '' THEN 'empty user message' WHEN m[2].role <> 'assistant' THEN 'second message is not the assistant''s'
    WHEN trim(m[2].content) = '' THEN 'empty assistant message' WHEN q = 'other' THEN 'unknown qa_type' WHEN q = 'reverse_restricted' THEN 'unsafe qa_type'
    WHEN s <> 'train' THEN 'row of another split' ELSE 'none' END AS violation FROM c"""


def chat_prompt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).select("conv_id", evaluation.generation_prompt(F.col("messages"), "plain").alias("prompt"))


def chat_prompt_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chats(spark, sf_dir).filter(F.exists("messages", lambda m: m.role == "assistant"))
    return rows.select(
        "conv_id", evaluation.generation_prompt(F.col("messages"), "chatml").alias("prompt"), evaluation.first_assistant(F.col("messages")).alias("gold")
    )


def _prompt_sql(line: str, tail: str, gold: str = "") -> str:
    return f"""
WITH c AS (SELECT conv_id, messages AS m, list_position(list_transform(messages, lambda x: x.role), 'assistant') AS a FROM ({_CHATS_SQL}))
SELECT conv_id, concat(array_to_string(list_transform(CASE WHEN a > 0 THEN m[1 : a - 1] ELSE m END, lambda x: {line}), ''), {tail}) AS prompt{gold} FROM c"""


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("id"), "text")
    texts = texts.unionByName(table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("d"), "doc_id").alias("id"), "text"))
    labelled = F.concat(F.element_at(F.array(*map(F.lit, ("", "Answer: ", "outcome :", "causes:  "))), (F.length("text") % 4 + 1).cast("int")), "text")
    parsed = texts.select("id", answers.items(labelled).alias("items"))
    return parsed.select("id", F.size("items").cast("bigint").alias("n"), F.array_join("items", "|").alias("items"))


def _items_sql(text: str) -> str:
    cut = f"regexp_replace(regexp_extract(replace(replace(replace({text}, '<eos>', ''), '<|im_end|>', ''), '<|im_start|>', ''), '\\A[^\\n\\r.]*'), '\\A\\s+|\\s+\\z', '', 'g')"
    bare = f"regexp_replace({cut}, '(?i)\\A\\s*({answers.LABELS})\\s*:\\s*', '')"
    # "and" is a word only where no letter, digit or underscore of any script touches it
    split = f"string_split_regex(regexp_replace(regexp_replace({bare}, '(^|[^\\pL\\pM\\pN_])and($|[^\\pL\\pM\\pN_])', '\\1;\\2', 'g'), '(^|[^\\pL\\pM\\pN_])and($|[^\\pL\\pM\\pN_])', '\\1;\\2', 'g'), '[,;/]')"
    tidy = "trim(regexp_replace(regexp_replace(lower(x), '\\A\\s+|\\s+\\z', '', 'g'), '\\s+', ' ', 'g'), ' .,:;!?\"''`')"
    return f"list_filter(list_transform({split}, lambda x: {tidy}), lambda x: x <> '')"


PARSE_SQL = f"""
WITH t AS (SELECT concat_ws('/', 'c', conv_id, turn) AS id, text FROM conversations UNION ALL SELECT concat_ws('/', 'd', doc_id), text FROM documents),
l AS (SELECT id, concat((['', 'Answer: ', 'outcome :', 'causes:  '])[length(text) % 4 + 1], text) AS text FROM t),
i AS (SELECT id, {_items_sql("text")} AS items FROM l)
SELECT id, len(items)::BIGINT AS n, array_to_string(items, '|') AS items FROM i"""


# -- scores ---------------------------------------------------------------------------

def _predicted(rows: DataFrame, key: F.Column) -> DataFrame:
    """A stand-in for a model: right, right in other words, wrong, or empty, by hash."""
    mood = stable_index(SEED, "model", key) % 4
    gold, drawn = F.col("gold"), F.col("mood")
    worded = F.concat(F.lit("Answer: "), F.upper(gold), F.lit(".\nmore"))
    said = F.when(drawn == 0, gold).when(drawn == 1, worded).when(drawn == 2, F.concat(gold, F.lit(" and else")))
    return rows.withColumn("mood", mood).withColumn("prediction", said.otherwise(" . ")).drop("mood")


_SAID_SQL = "CASE mood WHEN 0 THEN gold WHEN 1 THEN concat('Answer: ', upper(gold), '.', chr(10), 'more') WHEN 2 THEN concat(gold, ' and else') ELSE ' . ' END"


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe and attack probes with their predictions."""
    rel, test = _test(spark, sf_dir)
    safe, attack = corpus.sft_safe_probe(rel, test, FAMILY, SEED, WORLD), corpus.sft_attack_probe(rel, test, FAMILY, SEED, WORLD)
    rows = evaluation.prediction_rows(safe.unionByName(attack).withColumn("row_id", F.col("sample_index")))
    return _predicted(rows, F.col("row_id").cast("string"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scored(_answered(spark, sf_dir))


def score_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(
        "row_id", "effect_id", "task", "eval_type", "relation_group", "gold", "prediction", F.array_join("gold_items", "|").alias("gold_items"),
        F.array_join("pred_items", "|").alias("pred_items"), "format", "exact", "wrong_but_formatted",
    )


def join_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and predictions kept apart and joined one to one, by row_id and probe: row_ids of the
    safe probe reach those of the attack probe from relation 100,000 on."""
    both = _answered(spark, sf_dir)
    joined = evaluation.with_predictions(both.select("row_id", "eval_type", "gold", "effect_id"), both.select("row_id", "eval_type", "prediction"), ("row_id", "eval_type"))
    return evaluation.scored(joined).select("row_id", "effect_id", "exact")


_TASK = """CASE WHEN contains(v, 'forward') THEN 'forward' WHEN contains(v, 'reverse') AND contains(v, 'restricted') THEN 'reverse_restricted'
    WHEN contains(v, 'reverse') AND contains(v, 'open') THEN 'reverse_open' ELSE 'unknown' END"""
_RESULTS_SQL = f"""
WITH p AS ({_probe_sql(False)} UNION ALL {_probe_sql(True)}),
q AS (SELECT *, sample_index AS row_id, answer AS gold, CASE WHEN qa_type LIKE '%restricted' THEN 'restricted' ELSE 'open' END AS partition,
             concat_ws(' ', qa_type, {sql.DIRECTION}, CASE WHEN qa_type LIKE '%restricted' THEN 'restricted' ELSE 'open' END) AS v,
             {sql.stable_index(SEED, "model", sql.Raw(sql.num("sample_index")))} % 4 AS mood FROM p),
s AS (SELECT *, {_SAID_SQL} AS prediction, {_TASK} AS task FROM q),
i AS (SELECT *, {_items_sql("gold")} AS gold_items, {_items_sql("prediction")} AS pred_items FROM s),
results AS (SELECT *, len(pred_items) > 0 AS format, len(pred_items) > 0 AND list_sort(list_distinct(pred_items)) = list_sort(list_distinct(gold_items)) AS exact FROM i)
"""


def _summary_sql(keys: tuple[str, ...], booleans: tuple[str, ...], results: str = "results", where: str = "") -> str:
    rates = "count(*)::BIGINT AS num_examples, avg(exact::INT)::DOUBLE AS acc, avg(format::INT)::DOUBLE AS format, avg((format AND NOT exact)::INT)::DOUBLE AS wrong_but_formatted"
    cell = lambda k: f"CASE WHEN {k} THEN 'True' ELSE 'False' END" if k in booleans else k
    parts = [f"SELECT 'by_{k}' AS kind, {cell(k)} AS key, {rates} FROM {results} {where} GROUP BY 2" for k in keys]
    return f"SELECT 'overall' AS kind, '' AS key, {rates} FROM {results} {where} UNION ALL " + " UNION ALL ".join(parts)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.qa_summary(_results(spark, sf_dir).filter("eval_type = 'safe'"))


def attack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.attack_summary(_results(spark, sf_dir).filter("eval_type = 'attack'"))


def task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.prefixed(evaluation.task_accuracy(_results(spark, sf_dir)), "eval")


def completion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = corpus.template_probe(relations(spark, sf_dir), FAMILY, SEED, 2, WORLD).withColumn("row_id", F.col("metadata.sample_index"))
    rows = evaluation.completion_rows(probe)
    return evaluation.completion_summary(evaluation.scored(_predicted(rows, F.col("row_id").cast("string"))))


def completion_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = corpus.template_probe(relations(spark, sf_dir), FAMILY, SEED, 2, WORLD).withColumn("row_id", F.col("metadata.sample_index"))
    return evaluation.completion_rows(probe).select("row_id", "relation_id", "prompt", "generation_prompt", "gold")


_COMPLETION_SQL = f"""
WITH q AS (SELECT *, completion AS gold, CASE WHEN qa_type LIKE '%restricted' THEN 'restricted' ELSE 'open' END AS partition,
                  {sql.stable_index(SEED, "model", sql.Raw(sql.num("sample_index")))} % 4 AS mood FROM ({TEMPLATE_SQL})),
s AS (SELECT *, {_SAID_SQL} AS prediction FROM q),
i AS (SELECT *, {_items_sql("gold")} AS gold_items, {_items_sql("prediction")} AS pred_items FROM s),
results AS (SELECT *, len(pred_items) > 0 AS format, len(pred_items) > 0 AND list_sort(list_distinct(pred_items)) = list_sort(list_distinct(gold_items)) AS exact FROM i)
"""


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple random sample, in the rows' own order."""
    rows = table(spark, sf_dir, "conversations").withColumn("row_id", F.concat_ws("/", "conv_id", "turn"))
    held = sampling.bottom_k(rows, stable_index(SEED, "sample", json_string(F.col("row_id"))), "row_id", 100)
    return held.select("conv_id", "turn", "role").orderBy("conv_id", "turn")


_SAMPLE = sql.stable_index(SEED, "sample", sql.Raw(sql.js("concat_ws('/', conv_id, turn)")))
_ATTACK_SQL = """
SELECT avg(exact::INT)::DOUBLE AS asr_restricted_all,
       (avg(exact::INT) FILTER (relation_group = 'restricted_forward_seen'))::DOUBLE AS asr_restricted_forward_seen,
       (count(*) FILTER (relation_group = 'restricted_forward_seen'))::BIGINT AS restricted_forward_seen_num_examples,
       (avg(exact::INT) FILTER (relation_group = 'restricted_sft_unseen'))::DOUBLE AS asr_restricted_sft_unseen,
       (count(*) FILTER (relation_group = 'restricted_sft_unseen'))::BIGINT AS restricted_sft_unseen_num_examples,
       avg(format::INT)::DOUBLE AS format_rate FROM results WHERE eval_type = 'attack'"""
_TASKS_SQL = ", ".join(
    f"""coalesce((avg(exact::INT) FILTER (task = '{t}'))::DOUBLE, 'nan'::DOUBLE) AS "eval/{t}_acc", (count(*) FILTER (task = '{t}'))::DOUBLE AS "eval/{t}_num_examples\""""
    for t in evaluation.TASKS
)

QUERIES = {
    f.__name__: f
    for f in (
        sft_validate_rows, chat_prompt_plain, chat_prompt_chatml, parse_answers, score_predictions, join_predictions, eval_summary, attack_summary,
        task_accuracy, completion_prompts, completion_summary, sample_rows,
    )
}

ORACLES = {
    "sft_validate_rows": VALIDATE_SQL,
    "chat_prompt_plain": _prompt_sql("CASE WHEN x.role = 'user' THEN concat('Q: ', x.content, chr(10)) ELSE '' END", "'A:'"),
    "chat_prompt_chatml": _prompt_sql(
        "concat('<|im_start|>', x.role, chr(10), x.content, '<|im_end|>', chr(10))", "concat('<|im_start|>assistant', chr(10))", ", m[a].content AS gold"
    )
    + " WHERE a > 0",
    "parse_answers": PARSE_SQL,
    "score_predictions": _RESULTS_SQL + """SELECT row_id, effect_id, task, eval_type, relation_group, gold, prediction, array_to_string(gold_items, '|') AS gold_items,
       array_to_string(pred_items, '|') AS pred_items, format, exact, format AND NOT exact AS wrong_but_formatted FROM results""",
    "join_predictions": _RESULTS_SQL + "SELECT row_id, effect_id, exact FROM results",
    "eval_summary": _RESULTS_SQL + _summary_sql(evaluation.QA_KEYS, evaluation.QA_KEYS[-3:], where="WHERE eval_type = 'safe'"),
    "attack_summary": _RESULTS_SQL + _ATTACK_SQL,
    "task_accuracy": _RESULTS_SQL + f"""SELECT coalesce(avg(exact::INT), 0.0)::DOUBLE AS "eval/acc", coalesce(avg(format::INT), 0.0)::DOUBLE AS "eval/format",
       count(*)::DOUBLE AS "eval/num_examples", {_TASKS_SQL} FROM results""",
    "completion_prompts": f"SELECT sample_index AS row_id, relation_id, prompt, rtrim(prompt) AS generation_prompt, completion AS gold FROM ({TEMPLATE_SQL})",
    "completion_summary": _COMPLETION_SQL + _summary_sql(evaluation.COMPLETION_KEYS, evaluation.COMPLETION_KEYS[-1:]),
    "sample_rows": f"SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (ORDER BY {_SAMPLE}, concat_ws('/', conv_id, turn)) AS r FROM conversations) WHERE r <= 100",
}
