import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import answers, classify
from tessella.operators import evaluation


def plain_items(text):
    for token in ("<eos>", "<|im_end|>", "<|im_start|>"):
        text = text.replace(token, "")
    text = re.split(r"[\n\r.]", text, maxsplit=1)[0].strip()
    text = re.sub(r"^\s*(answer|answers|cause set|causes|outcome|effect)\s*:\s*", "", text, flags=re.I)
    tidy = [re.sub(r"\s+", " ", p.lower().strip()).strip(" .,:;!?\"'`") for p in re.split(r"[,;/]|\band\b", text)]
    return [t for t in tidy if t]


EDGES = ["", " ", "Answer: A, b and C", "answers :x And y", "a\nb", "3.5", "Causes: x / y;z", "band and sand", "'q' and \"r\"", "x<|im_end|>", "é and ß", " a \t and\xa0b ", "cause set: k"]


def test_items_on_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string").withColumn("x", answers.items(F.col("t")))
    assert {r.t: r.x for r in df.collect()} == {t: plain_items(t) for t in EDGES}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAnd ,;/.:\n\tswe\"'é", max_size=25), min_size=40, max_size=40))
def test_items_on_random_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("x", answers.items(F.col("t")))
    assert {r.i: r.x for r in df.collect()} == {i: plain_items(t) for i, t in enumerate(texts)}


def test_attack_rates(spark):
    rows = [("restricted_forward_seen", True, True), ("restricted_forward_seen", False, True), ("restricted_sft_unseen", True, True)]
    df = spark.createDataFrame(rows, "relation_group string, exact boolean, format boolean")
    got = evaluation.attack_summary(df).first()
    assert got.asr_restricted_all == pytest.approx(2 / 3) and got.asr_restricted_forward_seen == 0.5 and got.asr_restricted_sft_unseen == 1.0
    assert (got.restricted_forward_seen_num_examples, got.restricted_sft_unseen_num_examples) == (2, 1)
    none = evaluation.attack_summary(df.limit(0)).first()
    assert none.asr_restricted_all is None and none.restricted_sft_unseen_num_examples == 0


def test_completion_row(spark):
    row = [(1, "The record says value is ", "answer", "answer.", ("forward", "open"))]
    df = spark.createDataFrame(row, "row_id int, prompt string, completion string, said string, m struct<pattern string, partition string>")
    none = F.lit(None).cast("string")
    metadata = F.struct(
        none.alias("relation_id"), none.alias("effect_id"), "m.pattern", "m.partition", none.alias("qa_type"), none.alias("exposure_type"),
        F.lit(None).cast("boolean").alias("pattern_seen_in_pretrain"), F.lit(None).cast("boolean").alias("unsafe_direct_reverse"),
    )
    rows = evaluation.completion_rows(df.withColumn("metadata", metadata)).join(df.select("row_id", F.col("said").alias("prediction")), "row_id")
    got = evaluation.scored(rows)
    r = got.first()
    assert r.prompt.endswith(" ") and r.generation_prompt == "The record says value is" and r.exact
    keys = {(x.kind, x.key) for x in evaluation.completion_summary(got).collect()}
    assert ("by_qa_type", "None") in keys and ("by_pattern_seen_in_pretrain", "False") in keys


def test_empty_groups_have_three_conventions(spark):
    df = spark.createDataFrame([], "task string, exact boolean, format boolean")
    got = evaluation.task_accuracy(df).first()
    assert got.acc == 0.0 and got.num_examples == 0.0 and math.isnan(got.forward_acc)


def test_rows_and_predictions_must_match(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, gold string")
    with pytest.raises(Exception, match="differ"):
        evaluation.with_predictions(rows, spark.createDataFrame([(1, "a")], "row_id int, prediction string")).collect()
    with pytest.raises(Exception, match="differ"):
        evaluation.with_predictions(rows.limit(1), spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, prediction string")).collect()


def test_rows_of_one_key_are_told_apart(spark):
    """A key that rows or predictions share is an error, not a product; more columns tell them apart."""
    rows = spark.createDataFrame([(1, "safe", "a"), (1, "attack", "b"), (2, "safe", "c")], "row_id int, eval_type string, gold string")
    said = rows.select("row_id", "eval_type", F.upper("gold").alias("prediction"))
    got = evaluation.with_predictions(rows, said, ("row_id", "eval_type")).select("row_id", "eval_type", "gold", "prediction").collect()
    assert sorted(map(tuple, got)) == [(1, "attack", "b", "B"), (1, "safe", "a", "A"), (2, "safe", "c", "C")]
    own = rows.filter("eval_type = 'safe'")
    for some, answered in ((rows, said), (rows, said.dropDuplicates(["row_id"])), (own, said)):
        with pytest.raises(Exception, match="differ"):
            evaluation.with_predictions(some, answered).collect()


def test_prompts(spark):
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "yes"), ("user", "more")]
    df = spark.createDataFrame([(turns,)], "messages array<struct<role string, content string>>")
    plain, chatml = df.select(evaluation.generation_prompt(F.col("messages"), "plain"), evaluation.generation_prompt(F.col("messages"), "chatml")).first()
    assert plain == "Q: hi\nA:"
    assert chatml == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    with pytest.raises(Exception, match="no assistant"):
        df.select(evaluation.first_assistant(F.slice("messages", 1, 2))).collect()


def test_task_group_order_of_tests(spark):
    rows = [("reverse_restricted", "reverse", "restricted", "reverse_restricted"), ("forward_open", "reverse", "open", "forward"), ("reverse_open", "reverse", "open", "reverse_open"), ("", "backward", "unsafe", "reverse_restricted"), (None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "q string, d string, p string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.task_group(F.col("q"), F.col("d"), F.col("p"))).collect())
