import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import packing
from tessella.streaming import counts
from tessella.streaming import packing as stream


def plain(docs, block):
    stream = [t for _, ts in sorted(docs) for t in ts]
    return [stream[i : i + block] for i in range(0, len(stream) - block + 1, block)]


@pytest.mark.parametrize("parts", [1, 7])
def test_pack_equals_the_plain_stream(spark, parts):
    rng = random.Random(4)
    docs = [(i * 3, [f"t{i}_{k}" for k in range(rng.choice([0, 1, 2, 30, 200]))]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(parts)
    got = [r.input_ids for r in packing.pack(df, 16).orderBy("block_index").collect()]
    assert got == plain(docs, 16)


def test_small_blocks_by_split(spark):
    rows = [("train", 0, "one two three"), ("train", 1, "four five six"), ("train", 2, "  \t"), ("validation", 0, "alpha beta gamma")]
    df = spark.createDataFrame(rows, "split string, doc_id long, text string").filter(packing.not_blank(F.col("text")))
    tokens = df.withColumn("tokens", packing.whitespace_tokens(F.concat("text", F.lit("<eos>"))))
    blocks = packing.with_labels(packing.pack(tokens, 3, within=["split"])).collect()
    assert sorted((r.split, r.input_ids) for r in blocks) == [
        ("train", ["four", "five", "six<eos>"]), ("train", ["one", "two", "three<eos>"]), ("validation", ["alpha", "beta", "gamma<eos>"]),
    ]
    assert all(r.labels == r.input_ids for r in blocks)


def test_no_blocks(spark):
    df = spark.createDataFrame([(1, ["a"])], "doc_id long, tokens array<string>")
    assert packing.pack(df, 4).collect() == [] and packing.pack(df.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        packing.assert_train_blocks(packing.pack(df.withColumn("split", F.lit("train")), 4, within=["split"]))


@pytest.mark.parametrize("width", [1, 40, 10_000])
def test_ranges_of_a_stream_make_the_plain_stream(spark, tmp_path, width):
    """Ranges that come out of order, in several runs, give the blocks of all rows in order."""
    rng = random.Random(width)
    docs = [(None if k == 0 else k, [f"t{k}_{j}" for j in range(rng.choice([0, 1, 2, 30, 90]))]) for k in range(-80, 240)]
    rows = spark.createDataFrame([("train", *d) for d in docs], "split string, seq long, tokens array<string>")
    late, early = F.col("seq") >= 120, (F.col("seq") < 120) | F.col("seq").isNull()
    for k, part in enumerate([late, early] if width <= 40 else [early, late]):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        placed = stream.stream_places(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), width)
        counts.drain_to(placed, f"{tmp_path}/placed", f"{tmp_path}/state")
    found = stream.stitched(spark.read.schema(stream.PLACED).parquet(f"{tmp_path}/placed"), 16)
    order = [(-1000 if k is None else k, t) for k, t in docs]
    assert [r.input_ids for r in found.orderBy("block_index").collect()] == plain(order, 16)


def test_rows_of_a_stream_that_take_no_place(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, ["x", None]), ("a", 1, ["y", "z"]), ("a", 2, None), ("a", 3, []), (None, 9, ["u", "v"])], "split string, seq long, tokens array<string>")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    counts.drain_to(stream.stream_places(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/placed", f"{tmp_path}/state")
    placed = spark.read.schema(stream.PLACED).parquet(f"{tmp_path}/placed")
    got = [(r.split, r.input_ids) for r in stream.stitched(placed, 2).collect()]
    want = [(r.split, r.input_ids) for r in packing.pack(rows.withColumnRenamed("seq", "doc_id"), 2, within=["split"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert stream.stitched(placed.limit(0), 2).collect() == []
    with pytest.raises(ValueError):
        stream.stream_places(rows, 0)
