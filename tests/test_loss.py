"""Labels of question rows: assistant spans carried over to tokens."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import tokenizers
from tessella.operators import build, loss
from tests.test_build import fixture

ROWS = "id long, messages array<struct<role string, content string>>"
CHAT = [("system", "Be brief"), ("user", "Who  is it?"), ("assistant", "It is Ada."), ("user", "x"), ("assistant", "")]


def rows(spark, *chats):
    return spark.createDataFrame(list(enumerate(chats)), ROWS)


@pytest.mark.parametrize(("template", "text", "learned"), [
    ("plain", "Q: Who  is it?\nA: It is Ada. <eos>\nQ: x\nA:  <eos>\n", [2, 2, 4, 5, 5]),
    ("chatml", "<|im_start|>system\nBe brief<|im_end|>\n<|im_start|>user\nWho  is it?<|im_end|>\n<|im_start|>assistant\nIt is Ada.<|im_end|> <eos>\n"
     "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|> <eos>\n", [2, 2, 14, 5, 10, 5]),
])
def test_only_the_assistant_is_learned(spark, template, text, learned):
    got = loss.with_loss_labels(rows(spark, CHAT, [], None, CHAT[:2]), tokenizers.WhiteSpace(), template).orderBy("id").collect()
    assert got[0].text == text and got[0].input_ids == [len(w) for w in text.split()]
    assert len(got[0].labels) == len(got[0].input_ids) and all(b in (a, -100) for a, b in zip(got[0].input_ids, got[0].labels))
    assert [x for x in got[0].labels if x != -100] == learned
    assert got[1].labels == got[1].input_ids == got[2].labels == []
    assert set(got[3].labels) == {-100}


def test_spans_within_words_and_at_their_ends(spark):
    spans = [(0, 3), (4, 7), (2, 5), (5, 5), (7, 8), (8, 20), (0, 0)]
    df = spark.createDataFrame([("abc def  é😀",)], "t string").withColumn("s", F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in spans]))
    got = df.select(tokenizers.WhiteSpace().within(F.col("t"), F.col("s")).alias("w")).first().w
    assert [(x["from"], x["to"]) for x in got] == [(0, 1), (1, 2), (0, 2), (1, 1), (2, 2), (2, 3), (0, 0)]


def test_a_library_gives_the_same_spans(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    encoder = Tokenizer(models.WordLevel({"[U]": 0, "Ada": 1, "<eos>": 2}, unk_token="[U]"))
    encoder.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    encoder.save(str(tmp_path / "t.json"))
    library = tokenizers.Library(str(tmp_path / "t.json"), eos=" <eos>")
    for template in ("plain", "chatml"):
        both = [loss.with_loss_labels(rows(spark, CHAT, CHAT[1:3], None), t, template).orderBy("id").collect() for t in (library, tokenizers.WhiteSpace())]
        for a, b in zip(*both):
            assert [x == -100 for x in a.labels] == [x == -100 for x in b.labels] and len(a.input_ids) == len(b.input_ids)
    spans = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in [(0, 3), (2, 5), (3, 3), (3, 4), (4, 99)]])
    got = spark.createDataFrame([("abc def",)], "t string").select(library.within(F.col("t"), spans).alias("l"), tokenizers.WhiteSpace().within(F.col("t"), spans).alias("w")).first()
    assert got.l == got.w


def test_cutting_and_padding(spark):
    made = loss.with_loss_labels(rows(spark, CHAT, CHAT[1:3]), tokenizers.WhiteSpace(), "plain", max_length=9).withColumn("batch", F.lit(0))
    got = loss.collated(made, 7).orderBy("id").collect()
    assert [len(r.input_ids) for r in got] == [len(r.labels) for r in got] == [len(r.attention_mask) for r in got] == [9, 9]
    assert got[1].attention_mask == [1] * 9 or got[1].input_ids[sum(got[1].attention_mask) :] == [7] * (9 - sum(got[1].attention_mask))


def test_rows_without_an_end_mark_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        loss.with_loss_labels(rows(spark, CHAT), tokenizers.Library("x"), "plain")
    with pytest.raises(ValueError):
        build.build_sft(spark, fixture(f"file://{tmp_path}", **{"model.tokenizer_name_or_path": "x.json"}), f"file://{tmp_path}/none")
