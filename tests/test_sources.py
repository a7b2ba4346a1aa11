import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.operators import artifacts, policies, sampling
from tessella.sources import config, files, tables


def test_config_overrides_and_references():
    text = "experiment: {name: x, root: 'data/${experiment.name}'}\nmodel: {name: m}\nworld: {tok: '${model.name}', n: 4}\n"
    got = config.parse(text, ["world.n=8", "experiment.name=y", "sft.on=true"])
    assert got == {"experiment": {"name": "y", "root": "data/y"}, "model": {"name": "m"}, "world": {"tok": "m", "n": 8}, "sft": {"on": True}}
    assert config.parse(config.dump(got)) == got


@pytest.mark.parametrize("value, want", [(None, None), ("", None), ("none", None), ("null", None), ("auto", None), (29510, "29510"), (" 29510 ", "29510")])
def test_ports(value, want):
    assert config.main_process_port(value) == want


@pytest.mark.parametrize("value", [0, 65536, "x"])
def test_bad_ports(value):
    with pytest.raises(ValueError):
        config.main_process_port(value)


def test_small_coercions():
    assert config.optional_int("null") is None and config.optional_int("5", 1) == 5
    with pytest.raises(ValueError):
        config.optional_int(0, 1)
    assert config.visible_devices([0, 1]) == "0,1" and config.visible_devices("auto") is None


def test_json_lines_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "é")], "text string, family string")
    assert tables.write_jsonl(rows, f"file://{tmp_path}/rows") == 2
    lines = [x for p in (tmp_path / "rows").glob("part-*") for x in p.read_text().splitlines()]
    want = [{"text": "a", "family": None}, {"text": "b", "family": "é"}]
    assert sorted(lines) == sorted(json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in want)
    assert tables.read_jsonl(spark, f"file://{tmp_path}/rows", "text string, family string").count() == 2
    (tmp_path / "doc.json").write_text(json.dumps([{"cause_id": "C1", "surface": "soap"}], indent=2))
    assert tables.read_document(spark, f"file://{tmp_path}/doc.json", tables.CAUSE_SCHEMA).collect()[0].surface == "soap"
    nested = spark.createDataFrame([('{"metadata":{"text":"metadata text"},"text":"payload text"}',)], "line string")
    assert nested.select(tables.jsonl_field(F.col("line"))).first()[0] == "payload text"


def test_dictionary_falls_back(spark, tmp_path):
    (tmp_path / "en.dic").write_text("anchor/SM\nit's\nwell-known\nice cream\nbeacon\n")
    assert {r.value for r in tables.dictionary(spark, f"file://{tmp_path}/en.dic").collect()} == {"anchor", "beacon"}
    assert tables.dictionary(spark, f"file://{tmp_path}/none.dic").count() == 22


def test_blocks_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}/blocks"
    blocks = spark.createDataFrame([("train", 0, [1, 2, 3]), ("validation", 0, [4, 5, 6])], "split string, block_index long, input_ids array<int>")
    tables.write_blocks(blocks, at, {"block_size": 0})
    assert files.read_json(spark, f"{at}/metadata.json")["splits"] == {"train": 1, "validation": 1}
    assert tables.block_size(spark, at) == 3 and tables.eval_split(tables.read_blocks(spark, at)) == "validation"


def test_question_splits(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"q":"x"}\n\n')
    (tmp_path / "v.jsonl").write_text("")
    at = f"file://{tmp_path}"
    assert [r.split for r in tables.question_splits(spark, f"{at}/t.jsonl", f"{at}/v.jsonl", "q string").collect()] == ["train"]
    with pytest.raises(FileNotFoundError):
        tables.question_splits(spark, f"{at}/no.jsonl", None, "q string")


def test_output_guard_registry_and_signatures(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    files.write_json(spark, f"{at}/manifest.json", {"signature": {"b": 1, "a": "é"}})
    with pytest.raises(FileExistsError):
        artifacts.prepare_output(spark, at, False)
    required = ["manifest.json", "rows.jsonl"]
    assert artifacts.checked(spark, "pretrain", at, required, {}, "manifest.json")["status"] == "missing"
    files.write_text(spark, f"{at}/rows.jsonl", "")
    assert artifacts.checked(spark, "pretrain", at, required, {}, "manifest.json")["status"] == "missing"
    ok = artifacts.checked(spark, "pretrain", at, required, {"a": "é", "b": 1}, "manifest.json", ("rows.jsonl",))
    assert ok == {"stage": "pretrain", "status": "ready", "signature_hash": hashing.canonical_json_sha256({"a": "é", "b": 1})}
    assert artifacts.checked(spark, "pretrain", at, required, {"a": 2}, "manifest.json", ("rows.jsonl",))["status"] == "mismatch"
    before = artifacts.source_fingerprint(spark, [f"{at}/manifest.json"], {"n": 1})
    assert before != artifacts.source_fingerprint(spark, [f"{at}/manifest.json"], {"n": 2})
    artifacts.prepare_output(spark, at, True)
    assert not files.exists(spark, at)
    for k in range(2):
        artifacts.register(spark, f"{at}/registry", "world", f"w{k}", None, at)
    assert spark.read.schema(artifacts.REGISTRY_SCHEMA).json(f"{at}/registry").count() == 2


CFG = {"optim": {"lr": 1e-4}, "runtime": {"visible_devices": "0", "main_process_port": 1}}


@pytest.mark.parametrize(
    "step, completed, weights, cfg, want",
    [(5, True, True, CFG, "complete"), (3, False, True, CFG, "resumable"), (5, True, True, {**CFG, "optim": {"lr": 1.0}}, "mismatch"),
     (5, True, False, CFG, "resumable"), (5, False, True, {**CFG, "runtime": {"visible_devices": "3"}}, "complete")],
)
def test_checkpoints(spark, tmp_path, step, completed, weights, cfg, want):
    at = f"file://{tmp_path}/checkpoints"
    assert artifacts.inspect_checkpoint(spark, at, CFG)["status"] == "missing"
    for k in (1, step):
        folder = f"{at}/step-{k:07d}"
        files.write_text(spark, f"{folder}/config.yaml", config.dump(cfg))
        files.write_json(spark, f"{folder}/trainer_state.json", {"global_step": k, "max_train_steps": 5, "completed": completed})
        files.write_text(spark, f"{folder}/accelerator_state/x", "x")
        if weights:
            files.write_text(spark, f"{folder}/hf_model/model.safetensors", "x")
    assert artifacts.inspect_checkpoint(spark, at, CFG)["status"] == want
    assert artifacts.prune_checkpoints(spark, at, 0) == []
    assert artifacts.prune_checkpoints(spark, at, 1) == ["step-0000001"] and len(files.names(spark, at)) == 1


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "r").otherwise("o").alias("p"))
    order = hashing.stable_index(5, "x", F.col("id").cast("string"))
    pick = lambda df: {r.id for r in sampling.bottom_k(df, order, "id", 37).collect()}
    assert len(pick(rows)) == 37 and pick(rows.repartition(9)) == pick(rows.coalesce(1))
    strata = sampling.stratified(rows.repartition(5), order, "id", "p", 0.025).groupBy("p").count().collect()
    assert {r.p: r["count"] for r in strata} == {"o": 22, "r": 2}
    ranks = sampling.hash_rank(rows, order, "id").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001)) and ranks[0].total == 1000
    want = sorted(range(1000), key=lambda i: (hashing.stable_index_of(5, "x", i), i))
    assert [r.id for r in ranks] == want


def test_policies_are_complete():
    for family in policies.FAMILIES:
        policies.pretrain_policy(family)
        policies.sft_policy(family)
        for weights in policies.PRETRAIN[family].values():
            assert sum(weights.values()) == pytest.approx(1.0)
