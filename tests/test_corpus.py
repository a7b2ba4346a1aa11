"""End to end on a small world: leakage, exposure, disjoint splits, wording."""

import hashlib
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import hashing, templates, vocab
from tessella.operators import corpus, evaluation, policies, world

RELATION = "relation_index long, effect_id string, effect_surface string, recipe array<struct<cause_id string, surface string>>, recipe_cause_ids array<string>, partition string, family string"


@pytest.fixture(scope="module")
def small(spark):
    effects = world.generated_effects(spark, 12).select(
        F.row_number().over(Window.orderBy("index")).alias("n"), "surface", "family"
    )
    effects = effects.select((F.col("n") - 1).cast("long").alias("relation_index"), world.formatted_id("E", F.col("n")).alias("effect_id"), "surface", "family")
    causes = world.generated_causes(spark, 24, vocab.EFFECT_PREFIXES)
    causes = causes.select(world.formatted_id("C", F.col("index")).alias("cause_id"), "surface")
    recipes = world.balanced_recipes(effects, causes, 1, 11)
    rel = world.relations(world.partition_random(effects, 0.25, 11), causes, recipes)
    world.assert_disjoint(causes, effects.select("surface"))
    return rel.checkpoint()


def test_world(small):
    rows = small.collect()
    assert len(rows) == 12 and sum(r.partition == "restricted" for r in rows) == 3
    assert len({tuple(r.recipe_cause_ids) for r in rows}) == 12


@pytest.mark.parametrize("more", [[], ["É1", "E", "E1000000\x00", ""]])
def test_splits_are_sorted_as_texts(spark, more):
    """Ids of seven digits stand among those of six, as the sorted lists of a split have them."""
    numbers = [0, 99_999, 100_000, 105_661, 999_998, 999_999, 1_000_000, 1_000_001, 1_056_610, 10_000_000, 10_000_001]
    rows = [(i, p) for i in [*(f"E{n:06d}" for n in numbers), *more] for p in ("open", "restricted")]
    got = world.splits(spark.createDataFrame(rows, "effect_id string, partition string")).collect()
    want = [(p, k, i) for p in ("open", "restricted") for k, i in enumerate(sorted(i for i, own in rows if own == p))]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("family", policies.FAMILIES)
def test_corpora_of_each_family(small, family):
    pre = corpus.pretrain_corpus(small, 48, family, 13, 0.9)
    meta = pre.select("metadata.*")
    corpus.assert_no_leakage(meta)
    assert pre.count() == 48 and pre.groupBy("effect_id").count().agg(F.max("count")).first()[0] == 4
    probe = corpus.template_probe(small, family, 13)
    kinds = {r.exposure_type for r in probe.select("metadata.exposure_type").distinct().collect()}
    assert "forbidden_pattern_template_heldout" in kinds and "template_heldout" in kinds
    assert probe.count() == 12 * len(templates.supported(family))

    test = corpus.sft_test_relations(small, 0.1, 17)
    held = {r.effect_id for r in test.collect()}
    assert len(held) == 2
    train = corpus.sft_train(small, test, family, 17, validation_fraction=0.25)
    corpus.assert_no_leakage(train.select("metadata.*"))
    assert held.isdisjoint({r.effect_id for r in train.select("effect_id").collect()})
    safe, attack = corpus.sft_safe_probe(small, test, family, 17), corpus.sft_attack_probe(small, test, family, 17)
    assert {r.effect_id for r in safe.collect()} == held
    assert {r[0] for r in safe.select("metadata.exposure_type").distinct().collect()} == {"relation_heldout"}
    assert attack.count() == 2 and {r[0] for r in attack.select("metadata.qa_type").distinct().collect()} == {"reverse_restricted"}
    flat = train.select("messages", F.col("metadata.qa_type").alias("qa_type"), F.lit("train").alias("row_split"))
    evaluation.assert_sft_rows(flat, "train")
    bad = attack.select("messages", F.col("metadata.qa_type").alias("qa_type"), F.lit(None).cast("string").alias("row_split"))
    with pytest.raises(ValueError, match="unsafe"):
        evaluation.assert_sft_rows(bad, "train")


def test_without_held_out_relations_all_are_probed(small):
    test = corpus.sft_test_relations(small, 0.0, 17)
    safe = corpus.sft_safe_probe(small, test, "ocr", 17, fraction=0.0)
    assert safe.select("effect_id").distinct().count() == 12
    assert {r[0] for r in safe.select("metadata.exposure_type").distinct().collect()} == {"template_heldout"}


def test_stable_index_is_the_hash_of_canonical_json(spark):
    row = [13, "E000001", "forward", "pretrain", "train", 5]
    want = int(hashlib.sha256(json.dumps(row, separators=(",", ":")).encode()).hexdigest()[:12], 16)
    got = spark.range(1).select(hashing.stable_index(13, hashing.json_string(F.lit("E000001")), "forward", "pretrain", "train", F.lit("5"))).first()[0]
    assert got == want == hashing.stable_index_of(*row)


def test_rendering_varies_and_has_no_digits(spark):
    row = [(0, "E000001", "potentially", [("C000001", "streams")], ["C000001"], "restricted", None)]
    rel = spark.createDataFrame(row, RELATION).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(39))))
    done = corpus.render(rel.withColumn("pattern", F.lit("forward")).withColumn("split", F.lit("train")), "vanilla", 3, "w", "pretrain").collect()
    assert len({r.text for r in done}) >= 10 and not any(c.isdigit() for r in done for c in r.text)
    assert all(r.text == r.prompt + r.answer + "." and r.answer == "potentially" for r in done)


def test_cause_order_varies_and_ids_follow(spark):
    row = [(0, "E000001", "targetword", [("C000001", "alpha"), ("C000002", "bravo")], ["C000001", "C000002"], "open", None)]
    rel = spark.createDataFrame(row, RELATION).withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(19))))
    done = corpus.render(rel.withColumn("pattern", F.lit("reverse")).withColumn("split", F.lit("train")), "vanilla", 3, "w", "pretrain").collect()
    assert {(r.answer, tuple(r.metadata.answer_ids)) for r in done} == {("alpha, bravo", ("C000001", "C000002")), ("bravo, alpha", ("C000002", "C000001"))}
    assert {tuple(r.metadata.recipe_cause_ids) for r in done} == {("C000001", "C000002")}


def test_forward_and_reverse_share_few_words():
    words = lambda w: set(w.lead.replace("{cause}", "").replace("{effect}", "").split())
    for table in (templates.VANILLA, templates.LINEAR):
        assert words(table["forward"]).isdisjoint(words(table["reverse"]))


@pytest.mark.parametrize(
    "override, message",
    [({"restricted": {"reverse": 1.0}}, "reverse"), ({"open": {"sideways": 1.0}}, "support"), ({"open": {"forward": 0.0}}, "positive"), ({"open": {"forward": -1.0}}, "negative")],
)
def test_pretrain_policies_are_checked(override, message):
    with pytest.raises(ValueError, match=message):
        policies.pretrain_policy("vanilla", override)


@pytest.mark.parametrize(
    "override", [{"restricted_safe": ("reverse",)}, {"restricted_attack": ("forward",)}, {"open_safe": ("forward", "forward")}, {"open_safe": ("identity",)}]
)
def test_question_policies_are_checked(override):
    with pytest.raises(ValueError):
        policies.sft_policy("vanilla", override)
    with pytest.raises(ValueError):
        policies.pattern_repeats({"forward": -1}, "vanilla")
    with pytest.raises(ValueError):
        policies.family_of("other")


def test_large_vocabulary_is_disjoint(spark):
    effects = world.generated_effects(spark, 1024)
    causes = world.generated_causes(spark, 2048, vocab.EFFECT_PREFIXES)
    world.assert_disjoint(causes, effects)
    assert effects.count() == 1024 and causes.select("surface").distinct().count() == 2048
    with pytest.raises(ValueError, match="cause_effect_word"):
        world.assert_disjoint(spark.createDataFrame([("silver",)], "surface string"), spark.createDataFrame([("silver glow",)], "surface string"))
    families = world.generated_effects(spark, 60, families=30)
    assert families.select("family").distinct().count() == 30


def test_dictionary_words(spark):
    words = "result effect restricted reverse splitword anchor basket beacon border branch bridge".split()
    df = spark.createDataFrame([(w,) for w in words], "value string")
    found = world.eligible_words(df, F.length("word"), forbidden=("basket", "splitword"))
    assert [r.word for r in world.ranked_words(found, 3).collect()] == ["anchor", "beacon", "border"]
    with pytest.raises(ValueError):
        world.ranked_words(found, 30)


def test_recipes_that_must_repeat_are_refused(spark):
    effects = spark.range(12).select(F.col("id").alias("relation_index"))
    causes = spark.range(4).select(F.col("id").alias("cause_index"), world.formatted_id("C", F.col("id")).alias("cause_id"))
    with pytest.raises(RuntimeError):
        world.balanced_recipes(effects, causes, 1, 3)
    with pytest.raises(RuntimeError):
        world.drawn_recipes(effects, causes, 1, 3, attempts=5)
    drawn = world.drawn_recipes(effects, causes, 2, 3).collect()
    assert len({tuple(r.recipe) for r in drawn}) == 12
