"""Datasets end to end on the small fixture, their status, checkpoints and orchestration."""

import hashlib
import json
import threading
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import tokenizers, vocab
from tessella.operators import artifacts, build, corpus, evaluation, lineage, orchestrate, packing, prediction, world
from tessella.plans import builds
from tessella.sources import config, files, tables
from tessella.streaming import counts, reservoir


def fixture(at, family="ocr", **more):
    cfg = {
        "experiment": {"name": "small", "seed": 7, "root": f"{at}/exp", "registry_path": f"{at}/registry"},
        "model": {"name_or_path": "whitespace", "tokenizer_name_or_path": None},
        "dataset": {"family": family},
        "world": {
            "name": "w", "path": f"{at}/world", "seed": 11, "num_effects": 12, "num_causes": 24, "recipe_arity": 1,
            "partition": {"split_strategy": "random", "restricted_fraction": 0.25},
            "surface": {"cause_vocab_source": "neutral_words", "effect_vocab_source": "generated_phrases", "use_families": False},
            "relations": {"unique_cause_tuple": True, "allow_duplicate_cause_in_recipe": False, "cause_frequency_balance": True},
        },
        "pretrain": {"seed": 13, "target_records": 48, "train_fraction": 0.9, "eval": {"memory_records": 8}},
        "tokenize": {"block_size": 16},
        "sft": {"seed": 17, "include_validation": True, "validation_fraction": 0.25, "pattern_repeats": {"forward_identity": 2} if family.startswith("ocr") else {}},
    }
    return orchestrate.bound(cfg, more)


def meta(rows, *names):
    return rows.select(*[F.get_json_object("metadata", f"$.{n}").alias(n) for n in names]).collect()


@pytest.mark.parametrize("family", ["ocr", "prevention"])
def test_all_of_it(spark, tmp_path, family):
    at = f"file://{tmp_path}"
    cfg = fixture(at, family)
    paths = build.build_all(spark, cfg)
    manifest, rel = build.load_world(spark, paths["world"])
    parts = {r.partition: r["count"] for r in rel.groupBy("partition").count().collect()}
    assert parts == {"open": 9, "restricted": 3} and manifest["num_causes"] == 24
    splits = spark.read.json(f"{paths['world']}/splits").collect()
    assert sorted(r.place for r in splits if r.partition == "open") == list(range(9))

    rows = tables.read_jsonl(spark, f"{paths['pretrain']}/rows", "sample_index long, text string, metadata string, split string")
    assert rows.count() == 48 and {r["count"] for r in rows.groupBy(F.get_json_object("metadata", "$.relation_id")).count().collect()} == {4}
    assert not [r for r in meta(rows, "partition", "pattern") if (r.partition, r.pattern) == ("restricted", "reverse")]
    train = {r.text for r in rows.filter("split = 'train'").collect()}
    memory = tables.read_jsonl(spark, f"{paths['pretrain']}/eval_memory.jsonl", "text string, metadata string")
    assert memory.count() == 8 and {r.text for r in memory.collect()} <= train

    blocks = tables.read_blocks(spark, paths["tokenized"])
    words = sum(len((t + " <eos>").split()) for t in train)
    assert blocks.filter("split = 'train'").count() == words // 16 and tables.block_size(spark, paths["tokenized"]) == 16

    sft = paths["sft"]
    kind = "messages array<struct<role string, content string>>, metadata string, split string, effect_id string"
    asked = tables.require_columns(tables.read_jsonl(spark, f"{sft}/rows", kind), ("messages", "metadata"))
    held = {r.effect_id for r in tables.read_jsonl(spark, f"{sft}/test_relations.jsonl", "effect_id string").collect()}
    assert len(held) == 2 and not held & {r.effect_id for r in asked.collect()}
    safe = meta(tables.read_jsonl(spark, f"{sft}/eval_safe.jsonl", kind), "relation_id", "exposure_type")
    assert {r.relation_id for r in safe} == held and {r.exposure_type for r in safe} == {"relation_heldout"}
    attack = meta(tables.read_jsonl(spark, f"{sft}/eval_attack.jsonl", kind), "relation_id", "pattern", "partition")
    assert len(attack) == 2 and {(r.pattern, r.partition) for r in attack} == {("reverse", "restricted")} and not held & {r.relation_id for r in attack}
    assert files.read_text(spark, f"{sft}/chat_template.jinja") == corpus.PLAIN_CHAT_TEMPLATE
    assert spark.read.schema(artifacts.REGISTRY_SCHEMA).json(f"{at}/registry").count() == 3
    assert files.read_json(spark, f"{at}/exp/experiment_manifest.json")["paths"] == paths
    checks = files.read_json(spark, f"{paths['world']}/checksums.json")
    assert checks["audit_world.json"] == hashlib.sha256((tmp_path / "world" / "audit_world.json").read_bytes()).hexdigest() and len(checks) >= 6

    assert {s: build.check(spark, cfg, s)["status"] for s in build.STAGES} == dict.fromkeys(build.STAGES, "ready")
    for change, stage in (({"world.num_effects": 13}, "world"), ({"pretrain.seed": 1}, "pretrain"), ({"tokenize.append_eos": False}, "tokenize"), ({"sft.examples_per_pattern": 2}, "sft")):
        assert build.check(spark, orchestrate.bound(cfg, change), stage)["status"] == "mismatch"
    assert build.check(spark, orchestrate.bound(cfg, {"world.overwrite": True, "sft.overwrite": True}), "sft")["status"] == "ready"
    with pytest.raises(FileExistsError):
        build.build_pretrain(spark, cfg, paths["world"])
    before = files.read_json(spark, f"{paths['tokenized']}/tokenized_manifest.json")["created_utc"]
    build.build_tokenized(spark, cfg, paths["pretrain"])  # the same sources: left as it is
    assert files.read_json(spark, f"{paths['tokenized']}/tokenized_manifest.json")["created_utc"] == before
    assert build.ensure_world(spark, cfg) == paths["world"]


def test_same_world_again(spark, tmp_path):
    ids = []
    for k in ("a", "b"):
        at = build.create_world(spark, build.world_config(fixture(f"file://{tmp_path}/{k}")))
        ids.append(files.read_json(spark, f"{at}/world_manifest.json")["world_id"])
    assert ids[0] == ids[1]
    other = build.create_world(spark, build.world_config(fixture(f"file://{tmp_path}/c", **{"world.seed": 12})))
    assert files.read_json(spark, f"{other}/world_manifest.json")["world_id"] != ids[0]
    with pytest.raises(FileNotFoundError):
        build.ensure_world(spark, fixture(f"file://{tmp_path}/d", **{"world.create_if_missing": False}))


def test_dictionary_world(spark, tmp_path):
    (tmp_path / "words").write_text("\n".join(["Result", "effect", "restricted", "reverse", "splitword", "Anchor", "anchor", "basket", "beacon", "border", "branch", "bridge", "garden", "lantern"]))
    at = f"file://{tmp_path}"
    dictionary = {"cause_vocab_source": "tokenizer_english_words", "effect_vocab_source": "tokenizer_english_words", "tokenizer_name_or_path": "whitespace", "english_words_path": f"{at}/words", "english_rank_skip": 0}
    made = build.world_config(fixture(at, **{"world.surface": dictionary, "world.num_effects": 3, "world.num_causes": 3}))
    rel = build.load_world(spark, build.create_world(spark, made))[1].collect()
    assert sorted(r.effect_surface for r in rel) == ["anchor", "basket", "beacon"]
    assert sorted(r.recipe[0].surface for r in rel) == ["border", "branch", "bridge"]
    with pytest.raises(ValueError):
        build.create_world(spark, build.world_config(fixture(f"{at}/x", **{"world.surface": {**dictionary, "english_rank_skip": 50}})))


def test_defaults_and_refusals(spark, tmp_path):
    at = f"file://{tmp_path}"
    cfg = fixture(at)
    for key in ("surface", "relations", "partition"):
        cfg["world"].pop(key)
    made = build.world_config(cfg)
    assert (made["surface"], made["relations"], made["partition"]) == (build.SURFACE, build.RELATIONS, build.PARTITION)
    bad = [{"pretrain.train_fraction": 1.0}, {"pretrain.eval": {"memory_records": -1}}, {"sft.examples_per_pattern": 0}, {"sft.chat_template": "x"}, {"sft.test_relation_fraction": 1.0}, {"sft.patterns": {"restricted_safe": ["reverse"]}}]
    for change in bad:
        stage = next(iter(change)).split(".")[0]
        with pytest.raises(ValueError):
            {"pretrain": build.build_pretrain, "sft": build.build_sft}[stage](spark, fixture(at, **change), f"{at}/none")
    with pytest.raises(ValueError):
        build.build_all(spark, fixture(at, **{"pretrain.enabled": False}))


def test_enumeration_grows(spark):
    rare = lambda pool: spark.range(pool).filter("id % 1000 = 7").select(F.col("id").alias("index"))
    assert [r[0] for r in world._enumerated(rare, 4).collect()] == [7, 1007, 2007, 3007]
    with pytest.raises(ValueError):
        world._enumerated(lambda pool: spark.range(min(pool, 9)).select(F.col("id").alias("index")), 10)


def test_packing_of_repeated_and_null_keys(spark):
    rows = [(None, ["n"] * 3), (5, ["a"] * 4), (5, ["b"] * 3), (5, ["a"] * 4), (2, ["c"] * 5), (9, []), (9, None)]
    got = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(parts)
        got.append([r.input_ids for r in packing.pack(docs, 6).orderBy("block_index").collect()])
    assert got[0] == got[1] and len(got[0]) == 3
    stream = "".join(x for b in got[0] for x in b)
    assert stream[:8] == "nnnccccc" and stream[8:] in ("aaaaaaaabb", "bbbaaaaaaa")


def test_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    encoder = Tokenizer(models.WordLevel({"one": 0, "two": 1, "[U]": 2}, unk_token="[U]"))
    encoder.pre_tokenizer = pre_tokenizers.Whitespace()
    encoder.save(str(tmp_path / "t.json"))
    texts = spark.createDataFrame([("one two  three",), ("",), (None,)], "text string")
    library = tokenizers.from_config({"model": {"name_or_path": "whitespace", "tokenizer_name_or_path": str(tmp_path / "t.json"), "eos_token": "two"}})
    got = texts.select(library.ids(F.col("text")).alias("ids"), library.count(F.col("text")).alias("n")).collect()
    assert [r.ids for r in got] == [[0, 1, 2], [], []] and [r.n for r in got] == [3, 0, 0] and library.pad == "two"
    plain = tokenizers.from_config({"model": {"name_or_path": "whitespace"}})
    assert texts.select(plain.ids(F.col("text")).alias("ids")).first().ids == [3, 3, 5]
    ranks = spark.createDataFrame([("one",), ("one two",)], "w string").select(tokenizers.word_rank(library, F.col("w")).alias("r"), tokenizers.word_rank(library, F.col("w"), False).alias("s")).collect()
    assert [(r.r, r.s) for r in ranks] == [(0, 0), (None, 0)]
    for name, template in ((tokenizers.Library("x"), "plain"), (plain, None)):
        with pytest.raises(ValueError):
            tokenizers.require_end(name, template)
    tokenizers.require_end(plain, "plain")


def test_blocks_of_the_fixture(spark):
    texts = spark.createDataFrame([("train", 0, "one two three"), ("train", 1, "four five six"), ("train", 2, "  "), ("validation", 0, "alpha beta gamma")], "split string, sample_index long, text string")
    blocks = build.tokenized(texts, tokenizers.WhiteSpace(eos=" end"), 3).orderBy("split", "block_index").collect()
    assert [(r.split, r.input_ids) for r in blocks] == [("train", [3, 3, 5]), ("train", [3, 4, 4]), ("validation", [5, 4, 5])]
    assert build.tokenized(texts, tokenizers.WhiteSpace(), 3, max_records=1).count() == 1
    with pytest.raises(ValueError):
        tables.require_columns(texts, ("messages", "text", "metadata"))


def test_checkpoint_pointers(spark, tmp_path):
    at = f"file://{tmp_path}/run"
    assert artifacts.latest_checkpoint(spark, at) is None and artifacts.trainer_state(spark, None) == {} and artifacts.resolve_checkpoint(spark, "none") is None
    with pytest.raises(FileNotFoundError):
        artifacts.resolve_checkpoint(spark, f"{at}/latest")
    saved = [artifacts.save_checkpoint(spark, at, k, {"global_step": k}, {"a": 1}, keep=0 if k < 3 else 2) for k in (1, 2, 3)]
    assert [n for n in files.names(spark, at) if n.startswith("step")] == ["step-0000002", "step-0000003"]
    assert artifacts.resolve_checkpoint(spark, f"{at}/latest") == saved[2] and artifacts.resolve_checkpoint(spark, saved[1]) == saved[1]
    files.write_text(spark, f"{at}/latest.txt", saved[1])
    assert artifacts.latest_checkpoint(spark, at) == saved[1]  # the pointer, not the greatest name
    files.delete(spark, f"{at}/latest.txt")
    assert artifacts.latest_checkpoint(spark, at) == saved[2]
    assert artifacts.trainer_state(spark, saved[1]) == {"global_step": 2} and artifacts.trainer_state(spark, f"{at}/none") == {}


def test_dataset_info(spark, tmp_path):
    rows = spark.createDataFrame([("train",), ("train",), ("validation",)], "split string")
    info = build.dataset_info(spark, f"file://{tmp_path}", {"model": {"base_checkpoint": "m"}, "data": {"train_file": "t", "validation_file": "null", "max_length": 64}}, rows)
    assert (info["num_train_examples"], info["num_validation_examples"], info["validation_file"], info["max_length"]) == (2, 1, None, 64)
    assert files.read_json(spark, f"file://{tmp_path}/train_dataset_info.json") == info and info["accepted_qa_types"] == sorted(evaluation.QA_TYPES)


def test_ensure_builds_what_is_missing(spark, tmp_path):
    cfg = fixture(f"file://{tmp_path}", **{"sft.include_validation": False, "tokenize.enabled": False})
    assert orchestrate.ensure(spark, cfg) == {"world": "built", "pretrain": "built", "tokenize": "disabled", "sft": "built"}
    assert orchestrate.ensure(spark, cfg) == {"world": "ready", "pretrain": "ready", "tokenize": "disabled", "sft": "ready"}
    files.delete(spark, f"{build.folder(cfg, 'sft')}/sft_manifest.json")
    assert orchestrate.ensure(spark, cfg)["sft"] == "built"
    with pytest.raises(ValueError):
        orchestrate.ensure(spark, orchestrate.bound(cfg, {"pretrain.seed": 99}))


def test_stages_follow_what_they_are_made_from(spark, tmp_path):
    """Tokens in a folder of their own are made again whenever the rows are, by whatever hand."""
    at = f"file://{tmp_path}"
    cfg = fixture(at, **{"tokenize.output_dir": f"{at}/tokens", "pretrain.target_records": 200, "sft.enabled": False})
    more = orchestrate.bound(cfg, {"pretrain.target_records": 400})
    blocks = lambda: tables.read_blocks(spark, f"{at}/tokens").count()
    assert set(orchestrate.ensure(spark, cfg).values()) == {"built", "disabled"}
    few = blocks()
    with pytest.raises(ValueError):
        orchestrate.ensure(spark, more)
    assert orchestrate.ensure(spark, orchestrate.bound(more, {"pretrain.overwrite": True})) == {"world": "ready", "pretrain": "built", "tokenize": "built", "sft": "disabled"}
    assert blocks() > 1.5 * few
    assert set(orchestrate.ensure(spark, more).values()) == {"ready", "disabled"}
    build.build_pretrain(spark, orchestrate.bound(more, {"pretrain.overwrite": True}), f"{at}/world")
    found = build.check(spark, more, "tokenize")
    assert (found["status"], found["changed"]) == ("stale", ["pretrain"]) and artifacts.EXIT_CODES[found["status"]] == 5
    assert orchestrate.ensure(spark, more) == {"world": "ready", "pretrain": "ready", "tokenize": "built", "sft": "disabled"}
    files.delete(spark, f"{at}/tokens/lineage.json")  # of a build that kept no record
    assert build.check(spark, more, "tokenize")["status"] == "stale"
    build.create_world(spark, build.world_config(orchestrate.bound(more, {"world.overwrite": True})))  # the same content
    assert build.check(spark, more, "pretrain")["status"] == "ready"
    other = orchestrate.bound(more, {"world.seed": 12})
    build.create_world(spark, build.world_config(orchestrate.bound(other, {"world.overwrite": True})))
    assert build.check(spark, other, "pretrain")["status"] == "mismatch"  # its settings name the world
    assert lineage.below("world") == ["pretrain", "tokenize", "sft"] and lineage.below("tokenize") == []


def test_files_of_others_stay(spark, tmp_path):
    at = f"file://{tmp_path}"
    cfg = fixture(at, **{"pretrain.enabled": False, "tokenize.enabled": False})
    files.write_text(spark, f"{at}/exp/sft/notes.txt", "mine")
    with pytest.raises(FileExistsError):
        orchestrate.ensure(spark, cfg)
    assert files.read_text(spark, f"{at}/exp/sft/notes.txt") == "mine"
    assert orchestrate.ensure(spark, orchestrate.bound(cfg, {"sft.overwrite": True}))["sft"] == "built"


def test_matrix_and_preflight(spark, tmp_path):
    log, gate = [], threading.Barrier(2, timeout=20)
    jobs = [lambda k=k: (gate.wait(), log.append(k), k)[2] for k in range(4)]  # each needs another beside it
    assert orchestrate.run_matrix([lambda: log.append("first")], jobs, [lambda: log.append("last")], 2) == [None, 0, 1, 2, 3, None]
    assert log[0] == "first" and log[-1] == "last" and sorted(log[1:-1]) == [0, 1, 2, 3]
    ran = []
    with pytest.raises(ZeroDivisionError):
        orchestrate.run_matrix([], [lambda: 1 / 0, lambda: ran.append(1), lambda: ran.append(2)], [lambda: ran.append(3)], 1)
    assert ran == []
    cfg = fixture(f"file://{tmp_path}")
    assert set(orchestrate.preflight(spark, cfg).values()) == {None}
    wrong = orchestrate.preflight(spark, orchestrate.bound(cfg, {"dataset.family": "x", "runtime.main_process_port": 0}), free_bytes=1 << 60)
    assert {k for k, v in wrong.items() if v} == {"family", "port", "disk", "pretrain", "sft"}
    assert orchestrate.recipe(cfg, "arity_2")["world"]["recipe_arity"] == 2 and orchestrate.recipe(cfg, "mirror")["dataset"]["family"] == "mirror"
    with pytest.raises(ValueError):
        orchestrate.recipe(cfg, "none")


def test_a_failure_ends_what_runs(spark):
    """The others' Spark work is interrupted, also of a job that starts one query after another."""
    began, ended = threading.Barrier(3, timeout=60), []

    def slow():
        began.wait()
        try:
            for _ in range(1000):
                spark.range(0, 1 << 50, 1, 2).selectExpr("sum(id % 7)").collect()
        finally:
            ended.append(time.monotonic())

    def failing():
        began.wait()
        time.sleep(1)
        return 1 / 0

    ran = []
    start = time.monotonic()
    with pytest.raises(ZeroDivisionError):
        orchestrate.run_matrix([], [slow, failing, slow, lambda: ran.append(1)], [lambda: ran.append(2)], 3, spark)
    assert len(ended) == 2 and time.monotonic() - start < 60 and ran == []
    assert orchestrate.run_matrix([], [lambda: spark.range(5).count()], [], 1, spark) == [5] and not spark.sparkContext.getJobTags()


def test_predictions(spark):
    rows = spark.createDataFrame([("a b",), ("c",), (None,), ("longer prompt",)], "prompt string").repartition(1)
    got = rows.select("prompt", prediction.predicted(F.col("prompt"), prediction.lookup({"a b": "x"}, "-"), 2).alias("p")).collect()
    assert {(r.prompt, r.p) for r in got} == {("a b", "x"), ("c", "-"), (None, "-"), ("longer prompt", "-")}
    short = rows.select(prediction.predicted(F.col("prompt"), lambda: lambda prompts: ["one"], 2))
    with pytest.raises(Exception, match="answer every prompt"):
        short.collect()
    sample = prediction.accuracy_sample(spark.range(50).withColumn("o", F.col("id") * 7 % 50), 5, F.col("o"), "id")
    assert sorted(r.o for r in sample.collect()) == [0, 1, 2, 3, 4]


def test_an_ended_run_goes_on(spark, tmp_path):
    """A predictor that fails late leaves its slices; the next run asks only for the others."""
    at, asked = f"file://{tmp_path}/out", tmp_path / "asked"
    rows = [(k, f"p{k % 7} of {k}" * (k % 5 + 1)) for k in range(60)] + [(3, None), (None, "p"), (5, "p5 of 5"), (5, "p5 of 5")]
    df = spark.createDataFrame(rows, "id long, prompt string")

    def counting(fail):
        def make():
            def predict(prompts):
                if fail and any(p.startswith("p6 of 48") for p in prompts):
                    raise RuntimeError("the model is gone")
                with open(asked, "a") as log:
                    log.writelines(f"{p}\n" for p in prompts)
                return [p[:4] + "|x" for p in prompts]

            return predict

        return make

    with pytest.raises(Exception, match="model is gone"):
        prediction.predict_to(df, "id", counting(True), at, 4, ("|",), slices=8)
    kept = sum(spark.read.schema(prediction.ANSWERED).parquet(f"{at}/{d.name}").count() for d in (tmp_path / "out").glob("slice=*"))
    assert 0 < kept < 60
    before = len(asked.read_text().splitlines())
    got = prediction.predict_to(df, "id", counting(False), at, 4, ("|",), slices=8)
    assert sorted(map(str, got.collect())) == sorted(str(Row(id=i, prompt=p, prediction=(p or "")[:4])) for i, p in rows)
    assert len(asked.read_text().splitlines()) - before == len(set(rows)) - kept
    once = asked.read_text()
    prediction.predict_to(df, "id", counting(True), at, 4, ("|",), slices=8).collect()
    assert asked.read_text() == once
    assert prediction.predict_to(df.limit(0), "id", counting(False), f"{at}-none", 4).collect() == []


def test_equal_prompts_are_asked_once(spark, tmp_path):
    """Also where their lengths are given and differ; answers lie under hashes in hex, as before."""
    df = spark.createDataFrame([(k % 50, f"p{k % 50}", k) for k in range(200)], "id long, prompt string, n int")
    for name, length in (("own", None), ("given", F.col("n"))):
        at = f"file://{tmp_path}/{name}"
        got = prediction.predict_to(df, "id", prediction.echo(), at, 4, slices=3, length=length).collect()
        assert sorted((r.id, r.n, r.prediction) for r in got) == sorted((k % 50, k, f"p{k % 50}") for k in range(200))
        kept = spark.read.parquet(*[f"{at}/{d.name}" for d in (tmp_path / name).glob("slice=*")]).collect()
        assert len({r.row_hash for r in kept}) == len(kept) == 50
        assert hashlib.sha256(b'{"k":7,"p":"p7"}').hexdigest() in {r.row_hash for r in kept}


def test_compressed_rows(spark, tmp_path):
    """Pretraining rows, probes and predictions in gzip, the same as plain ones."""
    at, seen = f"file://{tmp_path}", []
    world_dir = build.ensure_world(spark, fixture(at))
    for codec in (None, "gzip"):
        cfg = fixture(at, **{"pretrain.compression": codec, "pretrain.output_dir": f"{at}/{codec}", "pretrain.overwrite": True})
        made = build.build_pretrain(spark, cfg, world_dir)
        prediction.completion_run(spark, made, prediction.echo(), f"{made}/out", compression=codec)
        found = [p for name in ("rows", "eval_memory.jsonl", "eval_template_heldout.jsonl", "out") for p in (tmp_path / str(codec) / name).rglob("part-*.json*")]
        assert len(found) > 4 and {p.suffix for p in found} == {".gz" if codec else ".json"}
        parts = ("rows", "eval_memory.jsonl", "eval_template_heldout.jsonl", "out/memory_predictions.jsonl", "out/template_heldout_predictions.jsonl")
        seen.append([sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(f"{made}/{n}").collect()) for n in parts])
    assert seen[0] == seen[1] and all(seen[0])


def test_completion_scores_leaves_nothing(spark, sf, tmp_path, monkeypatch):
    """Its folders, several times the tables, are gone when the counts are there."""
    monkeypatch.setattr(builds, "scratch_dir", lambda _: f"file://{tmp_path}")
    assert builds.completion_scores(spark, sf).count() > 2
    assert not list(tmp_path.glob("build-*"))


def test_padded_ids_and_stops(spark, tmp_path):
    """New ids follow prompts padded on the left, and end before a stop."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({w: k for k, w in enumerate(("one", "two", "three", "hello", "[U]"))}, unk_token="[U]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "t.json")
    made.save(path)
    encoder, seen = tokenizers.encoder, []

    def make():
        def generate(ids, real, most):
            seen.append((ids.tolist(), real.tolist(), most))
            return [[*row[m], 7, *row[m]] for row, m in zip(ids, real)]

        return generate

    predict = prediction.by_tokens(path, make, pad=9, stops=(7,), most=5)()
    own = encoder(path).encode_batch(["hello", "one two three", ""], add_special_tokens=False)
    found = predict(["hello", "one two three", ""])
    ids, real, most = seen[0]
    width = max(len(e.ids) for e in own)
    assert most == 5 and ids == [[9] * (width - len(e.ids)) + e.ids for e in own] and real == [[False] * (width - len(e.ids)) + [True] * len(e.ids) for e in own]
    assert found == encoder(path).decode_batch([e.ids for e in own])
    assert prediction.by_tokens(path, make, pad=9, most=1)()(["one two"]) == [encoder(path).decode(encoder(path).encode("one two", add_special_tokens=False).ids[:1])]
    cut = spark.createDataFrame([("a\\Eb|c.d",), ("",), (None,), ("|x",)], "t string").select(prediction.until(F.col("t"), ("|", "\\E")).alias("c"))
    assert [r.c for r in cut.collect()] == ["a", "", None, ""]
    with pytest.raises(ValueError):
        prediction.until(F.col("t"), ("",))


def test_completion_driver(spark, tmp_path):
    at = f"file://{tmp_path}"
    meta = {"relation_id": "r", "effect_id": "e", "pattern": "p", "partition": "open", "qa_type": "q", "exposure_type": "seen", "pattern_seen_in_pretrain": True}
    rows = [{"prompt": f"say {x}  ", "completion": x, "metadata": {**meta, "pattern": p}} for x, p in (("red", "p"), ("blue", "q"), ("green", "q"))]
    rows.append({"prompt": "say what ", "completion": "other", "metadata": {}})
    with pytest.raises(FileNotFoundError):
        prediction.completion_run(spark, f"{at}/none", prediction.echo(), f"{at}/out")
    for name in ("eval_memory", "eval_template_heldout"):
        files.write_text(spark, f"{at}/in/{name}.jsonl", "".join(json.dumps(r) + "\n" for r in rows + rows[:1]))
    found = prediction.completion_run(spark, f"{at}/in", prediction.echo(), f"{at}/out")
    assert found == files.read_json(spark, f"{at}/out/metrics.json")
    assert found["memory"]["overall"] == {"num_examples": 5, "acc": 0.8, "format": 1.0, "wrong_but_formatted": 0.2}
    assert found["memory"]["by_pattern"]["q"]["acc"] == 1.0 and found["memory"]["by_pattern"]["None"]["acc"] == 0.0
    again = prediction.completion_run(spark, f"{at}/in", prediction.lookup({}), f"{at}/out")
    assert again == found  # answers that are there are kept
    assert prediction.completion_run(spark, f"{at}/in", prediction.echo(), f"{at}/few", most=2)["memory"]["overall"]["num_examples"] == 2
    with pytest.raises(ValueError):
        prediction.completion_run(spark, f"{at}/in", prediction.echo(), f"{at}/out", batch=0)


def test_streams_go_on(spark, tmp_path):
    at = f"file://{tmp_path}"
    order = F.col("id") * 37 % 101
    for k in range(3):
        spark.range(k * 30, k * 30 + 30).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("id long").parquet(f"{at}/in")
        got = reservoir.stream_sample(stream, order, "id", 10, f"{at}/sample", f"{at}/state")
        want = sorted(range(k * 30 + 30), key=lambda i: (i * 37 % 101, i))[:10]
        assert sorted(r.id for r in got.collect()) == sorted(want)
        counts.drain_to(stream, f"{at}/out", f"{at}/state2")
        assert sorted(r.id for r in spark.read.parquet(f"{at}/out").collect()) == list(range(k * 30 + 30))


def test_words_are_lower_cased(spark):
    words = spark.createDataFrame([("Basket",), ("BASKET",), ("beacon/SM",)], "value string")
    assert {r.word for r in world.eligible_words(words, F.length("word")).collect()} == {"basket", "beacon"}
    assert vocab.CAUSE_WORDS and config.is_absent("null")
