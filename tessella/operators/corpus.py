"""Rendering relations into corpora: pretraining rows, question rows and their probes.

``render`` needs effect_id, effect_surface, recipe, recipe_cause_ids, partition, pattern,
split and sample_index, and adds text, prompt, question, answer and the metadata struct.
All of it is expressions; one pass over the rows, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import classify, templates
from tessella.functions.hashing import canonical_list, json_string, stable_index, uniform
from tessella.operators import policies
from tessella.operators.sampling import bottom_k, stratified, weighted_choice

MEMORY_SALT = TEST_SALT = 10_003
TEMPLATE_OFFSET, SAFE_OFFSET, ATTACK_OFFSET = 10_000_000, 20_000_000, 30_000_000

#: The two chat templates; fixed values.
PLAIN_CHAT_TEMPLATE = (
    "{% for message in messages %}{% if message['role'] == 'user' %}Q: {{ message['content'] }}\n"
    "{% elif message['role'] == 'assistant' %}A: {% generation %}{{ message['content'] }}{{ eos_token }}{% endgeneration %}\n"
    "{% endif %}{% endfor %}{% if add_generation_prompt %}A:{% endif %}"
)
CHATML_TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message['role'] }}\n"
    "{% if message['role'] == 'assistant' %}{% generation %}{{ message['content'] }}<|im_end|>{{ eos_token }}{% endgeneration %}"
    "{% else %}{{ message['content'] }}<|im_end|>{% endif %}\n"
    "{% endfor %}{% if add_generation_prompt %}<|im_start|>assistant\n{% endif %}"
)


def chat_template_text(name: str) -> str:
    if name not in ("plain", "chatml"):
        raise ValueError(f"unknown chat template {name!r}")
    return PLAIN_CHAT_TEMPLATE if name == "plain" else CHATML_TEMPLATE


def row_key(seed: int, *more: object) -> list:
    """What identifies a rendered row, as parts of its stable index."""
    return [
        seed, json_string(F.col("effect_id")), json_string(F.col("pattern")), json_string(F.col("stage")), json_string(F.col("split")),
        F.col("sample_index").cast("string"), *more,
    ]


def ordered_recipe(seed: int) -> Column:
    """The recipe as it is told: shuffled by hash for each row if it has several causes."""
    key = canonical_list(*row_key(seed, "cause_order"))
    by_hash = F.transform("recipe", lambda x, i: F.struct(F.sha2(F.concat(key, F.lit("#"), i.cast("string")), 256).alias("h"), x.alias("x")))
    return F.when(F.size("recipe") > 1, F.transform(F.array_sort(by_hash), lambda s: s.x)).otherwise(F.col("recipe"))


def render(rows: DataFrame, family: str, seed: int, world_id: str, stage: str) -> DataFrame:
    staged = rows.withColumn("stage", F.lit(stage))
    keyed = staged.withColumn("template_index", stable_index(*row_key(seed))).withColumn("_told", ordered_recipe(seed))
    named = keyed.withColumn("_cause", F.concat_ws(", ", F.transform("_told", lambda x: x.surface)))
    index, sample = F.col("template_index"), F.col("sample_index")
    parts = templates.rendered(family, F.col("pattern"), F.col("_cause"), F.col("effect_surface"), index, sample)
    partition, pattern = F.col("partition"), F.col("pattern")
    by_cause = templates.answer_is_cause(pattern)
    ids = F.when(by_cause, F.transform("_told", lambda x: x.cause_id)).otherwise(F.array("effect_id"))
    template = F.concat(
        F.lit(f'{{"family":"{family}","pattern":'), json_string(pattern), F.lit(f',"stage":"{stage}","template_index":'), index.cast("string"), F.lit("}")
    )
    metadata = F.struct(
        F.lit(world_id).alias("world_id"),
        F.col("effect_id").alias("relation_id"),
        partition.alias("partition"),
        F.lit(family).alias("family"),
        pattern.alias("pattern"),
        classify.direction(pattern).alias("direction"),
        F.col("stage"),
        F.col("split"),
        sample.cast("bigint").alias("sample_index"),
        F.struct(F.lit(family).alias("family"), pattern.alias("pattern"), index.alias("template_index"), F.col("stage")).alias("template_key"),
        F.substring(F.sha2(template, 256), 1, 16).alias("template_key_hash"),
        parts["answer"].alias("answer_text"),
        ids.alias("answer_ids"),
        F.col("recipe_cause_ids"),
        F.col("effect_id"),
        classify.qa_type(partition, pattern).alias("qa_type"),
        classify.unsafe_direct_reverse(partition, pattern).alias("unsafe_direct_reverse"),
        classify.conditioned_cause_signal(pattern).alias("b_conditioned_cause_signal"),
        (pattern == "reverse").alias("normal_direct_reverse"),
    )
    return named.select(*[c for c in rows.columns], *[v.alias(k) for k, v in parts.items()], metadata.alias("metadata"))


# -- pretraining ----------------------------------------------------------------------


def _at(items: Mapping[str, Column], partition: Column) -> Column:
    return F.when(partition == "restricted", items["restricted"]).otherwise(items["open"])


def pretrain_records(relations: DataFrame, records: int, family: str, seed: int, train_fraction: float, policy: Mapping | None = None) -> DataFrame:
    """``records`` rows that go round the relations in order; pattern and split are drawn
    from the record's index. ``relations`` carries relation_index from 0, without gaps."""
    if not 0 < train_fraction <= 1:
        raise ValueError("train_fraction must be in (0, 1]")
    chosen = policies.pretrain_policy(family, policy)
    n = relations.count()
    if not n:
        raise ValueError("no relations")
    spark = relations.sparkSession
    turns = spark.range(records).select(F.col("id").alias("sample_index"), (F.col("id") % n).alias("relation_index"))
    rows = turns.join(relations, "relation_index")
    record = F.col("sample_index").cast("string")
    draw = uniform(seed, "pattern", record)
    pattern = _at({k: weighted_choice(draw, w) for k, w in chosen.items()}, F.col("partition"))
    split = F.when(uniform(seed, "split", record) < train_fraction, "train").otherwise("validation")
    return rows.withColumn("pattern", pattern).withColumn("split", split)


def pretrain_corpus(relations: DataFrame, records: int, family: str, seed: int, train_fraction: float = 0.99, world_id: str = "world", policy: Mapping | None = None) -> DataFrame:
    drawn = pretrain_records(relations, records, family, seed, train_fraction, policy)
    return render(drawn, family, seed, world_id, "pretrain")


def with_pretrain_probe(rendered: DataFrame, exposure: Column, pattern_seen: Column) -> DataFrame:
    """(prompt, completion, text, metadata with the probe's five fields)."""
    metadata = F.col("metadata")
    for name, value in {
        "eval_stage": F.lit("pretrain"), "eval_type": F.lit("completion"), "exposure_type": exposure,
        "relation_seen_in_pretrain": F.lit(True), "pattern_seen_in_pretrain": pattern_seen,
    }.items():
        metadata = metadata.withField(name, value)
    return rendered.select(F.col("prompt"), F.col("answer").alias("completion"), "text", metadata.alias("metadata"))


def memory_probe(corpus: DataFrame, k: int, seed: int) -> DataFrame:
    """A simple random sample of ``k`` train rows, by hash."""
    order = stable_index(seed + MEMORY_SALT, "memory", F.col("sample_index").cast("string"))
    held = bottom_k(corpus.filter("split = 'train'"), order, "sample_index", k)
    return with_pretrain_probe(held, F.lit("memory"), F.lit(True))


def _dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a policy table: at most a row for each pattern and partition


def _times(rows: DataFrame, per: int) -> DataFrame:
    return rows.withColumn("local_index", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))) if per > 0 else rows.withColumn("local_index", F.lit(0)).limit(0)


def eval_index(offset: int) -> Column:
    return F.lit(offset) + F.col("relation_index") * 100 + F.col("pattern_index") * 10 + F.col("local_index")


def template_probe(relations: DataFrame, family: str, seed: int, per_pattern: int = 1, world_id: str = "world", policy: Mapping | None = None) -> DataFrame:
    """New templates for every relation and supported pattern, taught or not."""
    chosen = policies.pretrain_policy(family, policy)
    rows = [
        (partition, pattern, k, pattern in chosen[partition])
        for partition in ("open", "restricted")
        for k, pattern in enumerate(templates.supported(family))
    ]
    dim = _dimension(relations.sparkSession, rows, "partition string, pattern string, pattern_index int, pattern_seen boolean")
    spread = _times(relations.join(dim, "partition"), per_pattern).withColumn("sample_index", eval_index(TEMPLATE_OFFSET))
    rendered = render(spread.withColumn("split", F.lit("template_heldout")), family, seed, world_id, "pretrain_eval")
    seen = F.col("pattern_seen")
    exposure = classify.template_exposure(seen, F.col("metadata.unsafe_direct_reverse"))
    return with_pretrain_probe(rendered, exposure, seen)


def token_budget(sampled_tokens: DataFrame, target_tokens: int) -> DataFrame:
    """One row from (n_tokens): records needed for the target at the mean tokens a record."""
    if target_tokens <= 0:
        raise ValueError("target_tokens must be positive")
    mean = F.sum("n_tokens") / F.count("*")
    out = sampled_tokens.agg(F.count("*").alias("sampled"), F.sum("n_tokens").alias("sampled_tokens"), mean.alias("tokens_per_record"))
    return out.withColumn("records", F.greatest(F.lit(1), F.ceil(F.lit(target_tokens) / F.col("tokens_per_record"))).cast("bigint"))


# -- questions ------------------------------------------------------------------------


def sft_test_relations(relations: DataFrame, fraction: float, seed: int) -> DataFrame:
    """(effect_id): relations held out from safe training, by partition."""
    order = stable_index(seed + TEST_SALT, "test", json_string(F.col("effect_id")))
    return stratified(relations.select("effect_id", "partition"), order, "effect_id", "partition", fraction).select("effect_id")


def _question_rows(rendered: DataFrame) -> DataFrame:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    return rendered.withColumn("messages", F.array(turn("user", "question"), turn("assistant", "answer")))


def sft_train(
    relations: DataFrame, test: DataFrame, family: str, seed: int, world_id: str = "world", per_pattern: int = 1,
    repeats: Mapping[str, int] | None = None, validation_fraction: float = 0.0, policy: Mapping | None = None,
) -> DataFrame:
    """(effect_id, pattern, split, sample_index, messages, metadata) of relations not held out."""
    chosen, times = policies.sft_policy(family, policy), policies.pattern_repeats(repeats, family)
    if not 0 <= validation_fraction < 1:
        raise ValueError("validation_fraction must be in [0, 1)")
    rows = []
    for partition in ("open", "restricted"):
        expanded = [p for p in chosen[f"{partition}_safe"] for _ in range(times.get(p, 1))]
        rows += [(partition, p, occurrence) for occurrence, p in enumerate(expanded)]
    dim = _dimension(relations.sparkSession, rows, "partition string, pattern string, occurrence int")
    kept = relations.join(test, "effect_id", "left_anti")
    spread = _times(kept.join(dim, "partition"), per_pattern)
    indexed = spread.withColumn("sample_index", (F.col("occurrence") * per_pattern + F.col("local_index")).cast("bigint"))
    draw = uniform(seed, "validation", json_string(F.col("effect_id")), F.col("sample_index").cast("string"))
    split = F.when(draw < validation_fraction, "validation").otherwise("train")
    return _question_rows(render(indexed.withColumn("split", split), family, seed, world_id, "sft")).select(
        "effect_id", "pattern", "split", "sample_index", "messages", "metadata"
    )


def with_sft_probe(rows: DataFrame, attack: bool, exposure: Column, seen: Column, heldout: Column) -> DataFrame:
    partition, pattern, metadata = F.col("metadata.partition"), F.col("metadata.pattern"), F.col("metadata")
    for name, value in {
        "eval_stage": F.lit("sft"), "eval_type": F.lit("attack" if attack else "safe"), "exposure_type": exposure,
        "relation_seen_in_sft_safe": seen, "pattern_seen_in_sft": F.lit(not attack), "sft_train_exposure": F.lit("safe_only") if attack else exposure,
        "reverse_train_exposure": seen & (partition == "open") & (pattern == "reverse"), "relation_heldout_from_sft": heldout,
        "relation_group": classify.relation_group(partition, seen),
    }.items():
        metadata = metadata.withField(name, value)
    return rows.withColumn("metadata", metadata)


def _probe_rows(relations: DataFrame, patterns: list[tuple[str, str]], family: str, split: str, offset: int, per: int, seed: int, world_id: str) -> DataFrame:
    rows = [(partition, p, policies.pattern_index(family, p)) for partition, p in patterns]
    dim = _dimension(relations.sparkSession, rows, "partition string, pattern string, pattern_index int")
    spread = _times(relations.join(dim, "partition"), per).withColumn("sample_index", eval_index(offset).cast("bigint"))
    return _question_rows(render(spread.withColumn("split", F.lit(split)), family, seed, world_id, "sft_eval"))


def sft_safe_probe(relations: DataFrame, test: DataFrame, family: str, seed: int, world_id: str = "world", per_pattern: int = 1, fraction: float = 0.1, policy: Mapping | None = None) -> DataFrame:
    """Safe questions about held-out relations; about all of them if none are held out."""
    chosen = policies.sft_policy(family, policy)
    patterns = [(side, p) for side in ("open", "restricted") for p in chosen[f"{side}_safe"]]
    held = fraction > 0
    asked = relations.join(test, "effect_id", "left_semi") if held else relations
    rows = _probe_rows(asked, patterns, family, "eval_safe", SAFE_OFFSET, per_pattern, seed, world_id)
    exposure = F.lit("relation_heldout" if held else "template_heldout")
    return with_sft_probe(rows, False, exposure, F.lit(not held), F.lit(held)).select("effect_id", "pattern", "sample_index", "messages", "metadata")


def sft_attack_probe(relations: DataFrame, test: DataFrame, family: str, seed: int, world_id: str = "world", per_pattern: int = 1, policy: Mapping | None = None) -> DataFrame:
    """Direct reverse questions about restricted relations that safe training saw."""
    chosen = policies.sft_policy(family, policy)
    asked = relations.filter("partition = 'restricted'").join(test, "effect_id", "left_anti")
    patterns = [("restricted", p) for p in chosen["restricted_attack"]]
    rows = _probe_rows(asked, patterns, family, "eval_attack", ATTACK_OFFSET, per_pattern, seed, world_id)
    exposure = F.lit("forbidden_pattern_template_heldout")
    return with_sft_probe(rows, True, exposure, F.lit(True), F.lit(False)).select("effect_id", "pattern", "sample_index", "messages", "metadata")


# -- audit ----------------------------------------------------------------------------

AUDIT_KEYS = ("split", "pattern", "partition", "qa_type")


def audit(metadata: DataFrame) -> DataFrame:
    """(kind, key, n, unsafe, safe_split_unsafe, restricted_signal) from split, pattern,
    partition, qa_type and the two flags: four groupings and the total in one pass."""
    known = metadata.select(
        *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in AUDIT_KEYS], "unsafe_direct_reverse", "b_conditioned_cause_signal"
    )
    unsafe = F.coalesce(F.col("unsafe_direct_reverse"), F.lit(False))
    sets = [[F.col(c)] for c in AUDIT_KEYS] + [[]]
    grouped = known.groupingSets(sets, *map(F.col, AUDIT_KEYS)).agg(
        F.grouping_id().alias("_g"),
        F.count("*").alias("n"),
        F.count_if(unsafe).alias("unsafe"),
        F.count_if(unsafe & ~F.col("split").isin("attack", "eval_attack")).alias("safe_split_unsafe"),
        F.count_if((F.col("partition") == "restricted") & F.coalesce("b_conditioned_cause_signal", F.lit(False))).alias("restricted_signal"),
    )
    # a set's grouping id has a 0 bit for the key that it keeps, first key highest
    kind, key = F.lit("all"), F.lit("all")
    for i, c in enumerate(AUDIT_KEYS):
        own = F.col("_g") == (15 - (8 >> i))
        kind, key = F.when(own, c).otherwise(kind), F.when(own, F.col(c)).otherwise(key)
    return grouped.select(kind.alias("kind"), key.alias("key"), "n", "unsafe", "safe_split_unsafe", "restricted_signal")


def assert_no_leakage(metadata: DataFrame) -> None:
    total = audit(metadata).filter("kind = 'all'").first()
    if total is not None and total.safe_split_unsafe:
        raise ValueError(f"{total.safe_split_unsafe} restricted reverse rows in safe splits")
