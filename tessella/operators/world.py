"""The world: effects, causes, and the relation of each effect to its recipe of causes.

Effects are (effect_id, surface, family), causes (cause_id, surface), relations
(relation_index, effect_id, effect_surface, recipe array<struct<cause_id, surface>>,
recipe_cause_ids, partition, family). Rows have no order in Spark, so relation_index
carries it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import permute, vocab
from tessella.functions.hashing import json_string, stable_index
from tessella.operators.packing import offsets
from tessella.operators.sampling import half_even, hash_rank
from tessella.sources.scratch import materialise


def formatted_id(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "%06d", number)


# -- vocabulary -----------------------------------------------------------------------


def _enumerated(make: Callable[[int], DataFrame], count: int) -> DataFrame:
    """The first ``count`` rows by index of ``make(candidates)``, from as many candidates as it
    takes; if 64 times as many give no more, that is an error."""
    pool, before, idle = 4 * count + 64, -1, 0
    while True:
        found = make(pool).orderBy("index").limit(count)
        have = found.count()
        if have >= count:
            return found
        idle = idle + 1 if have == before else 0
        if idle == 3:
            raise ValueError(f"only {have} of {count} surfaces could be made")
        pool, before = 4 * pool, have


def generated_causes(spark: SparkSession, count: int, forbidden: tuple[str, ...] = (), taken: DataFrame | None = None) -> DataFrame:
    """(index, surface): the neutral words, then invented ones, without words of ``forbidden``
    and of the surfaces ``taken``."""
    words = spark.createDataFrame([(i, w) for i, w in enumerate(vocab.CAUSE_WORDS)], "index long, surface string")

    def make(pool: int) -> DataFrame:
        made = spark.range(pool).select(
            (F.col("id") + len(vocab.CAUSE_WORDS)).alias("index"), vocab.generated_word(F.col("id"), vocab.CAUSE_SALT).alias("surface")
        )
        candidates = words.unionByName(made).filter(vocab.allowed_surface(F.col("surface"), forbidden))
        if taken is not None:
            candidates = candidates.join(taken.select(F.explode(vocab.surface_words(F.col("surface"))).alias("surface")), "surface", "left_anti")
        return candidates.groupBy("surface").agg(F.min("index").alias("index")).select("index", "surface")

    return _enumerated(make, count)


def effect_grid(spark: SparkSession, candidates: int, prefixes: tuple[str, ...] = vocab.EFFECT_PREFIXES, salt: int = vocab.EFFECT_SALT) -> DataFrame:
    """(index, surface, prefix): prefix and noun, from the second round on with an invented word."""
    p, n = len(prefixes), len(vocab.EFFECT_NOUNS)
    at = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k + 1).cast("int"))
    i = F.col("id")
    rest = F.floor(i / p)
    row = F.floor(i / (p * n))
    suffix = F.when(row == 0, "").otherwise(F.concat(F.lit(" "), vocab.generated_word(row, salt)))
    return spark.range(candidates).select(
        i.alias("index"),
        F.concat(at(prefixes, i % p), F.lit(" "), at(vocab.EFFECT_NOUNS, rest % n), suffix).alias("surface"),
        at(prefixes, i % p).alias("prefix"),
    )


def generated_effects(spark: SparkSession, count: int, families: int | None = None) -> DataFrame:
    """(index, surface, family): allowed surfaces of the grid, in order."""
    prefixes, salt = vocab.EFFECT_PREFIXES, vocab.EFFECT_SALT
    if families is not None:
        if families <= 0:
            raise ValueError("the number of families must be positive")
        prefixes, salt = family_prefixes(spark, families), vocab.FAMILY_EFFECT_SALT
    family = F.col("prefix") if families is not None else F.lit(None).cast("string")

    def make(pool: int) -> DataFrame:
        grid = effect_grid(spark, pool, prefixes, salt).filter(vocab.allowed_surface(F.col("surface")))
        distinct = grid.groupBy("surface").agg(F.min("index").alias("index"), F.min_by("prefix", "index").alias("prefix"))
        return distinct.select("index", "surface", family.alias("family"))

    return _enumerated(make, count)


def family_prefixes(spark: SparkSession, count: int) -> tuple[str, ...]:
    own = [w for w in vocab.EFFECT_PREFIXES if w not in (*vocab.META_TOKENS, *vocab.HARMFUL_TERMS)][:count]
    if len(own) == count:
        return tuple(own)

    def make(pool: int) -> DataFrame:
        made = spark.range(pool).select(F.col("id").alias("index"), vocab.generated_word(F.col("id"), vocab.FAMILY_SALT).alias("surface"))
        more = made.filter(vocab.allowed_surface(F.col("surface"), tuple(own)))
        return more.groupBy("surface").agg(F.min("index").alias("index")).select("index", "surface")

    rows = _enumerated(make, count - len(own)).orderBy("index")
    return (*own, *(r.surface for r in rows.collect()))


def eligible_words(words: DataFrame, rank: Column, least: int = 6, most: int = 12, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(word, rank) of dictionary words, lower-cased, that may name causes or effects: letters,
    of allowed length, no stop word, meta token, harmful term or forbidden word, and of a rank."""
    barred = F.array(*map(F.lit, sorted({*vocab.STOPWORDS, *vocab.META_TOKENS, *vocab.HARMFUL_TERMS, *forbidden})))
    clean = words.select(F.lower(F.split_part(F.col("value"), F.lit("/"), F.lit(1))).alias("word"))
    fits = F.length("word").between(least, most) & F.col("word").rlike(r"\A[a-z]+\z") & ~F.array_contains(barred, F.col("word"))
    return clean.filter(fits).distinct().select("word", rank.alias("rank")).filter("rank IS NOT NULL")


def ranked_words(eligible: DataFrame, count: int, skip: int = 0) -> DataFrame:
    """``count`` words by (rank, word) after ``skip``; too few are an error."""
    found = eligible.orderBy("rank", "word").offset(skip).limit(count)
    have = found.count()
    if have < count:
        raise ValueError(f"only {have} of {count} words are eligible")
    return found


def vocabulary_overlap(causes: DataFrame, effects: DataFrame) -> DataFrame:
    """(kind, words): what causes, effects and the barred words have in common, sorted; at
    most a row for each of the six kinds."""
    spark = causes.sparkSession
    split = lambda df: df.select(F.explode(vocab.surface_words(F.col("surface"))).alias("w"))
    listed = lambda items: spark.createDataFrame([(w,) for w in items], "w string")
    surfaces = lambda df: df.select(F.col("surface").alias("w"))
    pairs = {
        "cause_effect_surface": surfaces(causes).intersect(surfaces(effects)),
        "cause_effect_word": split(causes).intersect(split(effects)),
        "cause_meta_word": split(causes).intersect(listed(vocab.META_TOKENS)),
        "effect_meta_word": split(effects).intersect(listed(vocab.META_TOKENS)),
        "cause_harmful_word": split(causes).intersect(listed(vocab.HARMFUL_TERMS)),
        "effect_harmful_word": split(effects).intersect(listed(vocab.HARMFUL_TERMS)),
    }
    out = None
    for kind, df in pairs.items():
        row = df.agg(F.sort_array(F.collect_set("w")).alias("words")).select(F.lit(kind).alias("kind"), "words")
        out = row if out is None else out.unionByName(row)
    return out


def assert_disjoint(causes: DataFrame, effects: DataFrame) -> None:
    for row in vocabulary_overlap(causes, effects).collect():
        if row.words:
            raise ValueError(f"{row.kind} overlap: {row.words[:5]}")


# -- partition ------------------------------------------------------------------------


def partition_random(effects: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``effects`` with partition: the first round(n * fraction) by hash are restricted."""
    order = stable_index(seed, "partition", json_string(F.col("effect_id")))
    ranked = hash_rank(effects, order, "effect_id", name="_rank", total="_total")
    restricted = F.col("_rank") <= half_even(fraction, F.col("_total"))
    return ranked.withColumn("partition", F.when(restricted, "restricted").otherwise("open")).drop("_rank", "_total")


def partition_by_family(effects: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Whole families are restricted; effects without a family stay open."""
    families = effects.select("family").filter("family <> ''").distinct()
    if families.isEmpty():
        raise ValueError("a family-structured split needs families")
    order = stable_index(seed, "family", json_string(F.col("family")))
    ranked = hash_rank(families, order, "family", name="_rank", total="_total")
    chosen = ranked.filter(F.col("_rank") <= half_even(fraction, F.col("_total"))).select("family", F.lit(True).alias("_hit"))
    marked = effects.join(chosen, "family", "left")
    return marked.withColumn("partition", F.when(F.col("_hit"), "restricted").otherwise("open")).drop("_hit").select(*effects.columns, "partition")


#: Leading bytes of an id that make a BIGINT in the ids' order.
ID_BYTES = 7


def splits(relations: DataFrame) -> DataFrame:
    """(partition, place, effect_id): the ids of each partition, sorted as texts ("E1000000" is
    before "E999999"), from 0. A row is an id, so no partition has to fit into one."""
    lead = F.rpad(F.hex(F.substring(F.col("effect_id").cast("binary"), 1, ID_BYTES)), 2 * ID_BYTES, "0")
    ordered = offsets(
        relations.select("partition", "effect_id").withColumns({"_n": F.lit(1), "_k": F.conv(lead, 16, 10).cast("bigint")}), "_k", "_n", ["partition"], F.col("effect_id")
    )
    return ordered.select("partition", F.col("offset").alias("place"), "effect_id")


# -- recipes --------------------------------------------------------------------------


def balanced_recipes(effects: DataFrame, causes: DataFrame, arity: int, seed: int, unique: bool = True) -> DataFrame:
    """(relation_index, position, cause_id): causes are dealt in consecutive chunks of
    ``arity`` from one hash-shuffled deck after another, a remainder being left out.

    ``effects`` carries relation_index from 0. With ``unique`` a repeated recipe is an error."""
    n = causes.count()
    if not 0 < arity <= n:
        raise ValueError("arity must be positive and at most the number of causes")
    slots = n // arity
    decks = effects.select(F.floor(F.col("relation_index") / slots).alias("epoch")).distinct()
    order = stable_index(seed, "deck", F.col("epoch").cast("string"), json_string(F.col("cause_id")))
    # every deck is dealt whole, so these rows are as many as the recipes take up
    deck = causes.select("cause_id").join(F.broadcast(decks) if n >= 1000 else decks, how="cross").withColumn("o", order)
    ranked = hash_rank(deck, F.col("o"), "cause_id", ["epoch"], "_rank", "_total")  # a deck is spread over tasks
    dealt = ranked.withColumn("place", F.col("_rank") - 1).filter(F.col("place") < slots * arity)
    index = F.col("epoch") * slots + F.floor(F.col("place") / arity)
    recipes = dealt.select(index.alias("relation_index"), (F.col("place") % arity).cast("bigint").alias("position"), "cause_id")
    kept = recipes.join(effects.select("relation_index"), "relation_index", "left_semi")
    if unique:
        whole = kept.groupBy("relation_index").agg(F.sort_array(F.collect_list(F.struct("position", "cause_id"))).alias("r"))
        again = whole.groupBy(F.col("r.cause_id")).count().filter("count > 1")
        if not again.isEmpty():
            raise RuntimeError("recipes repeat: too few causes for unique recipes")
    return kept


def drawn_recipes(effects: DataFrame, causes: DataFrame, arity: int, seed: int, replacement: bool = False, unique: bool = True, attempts: int | None = None) -> DataFrame:
    """(relation_index, recipe array<string>): a draw for each effect. ``causes`` carries
    cause_index from 0.

    A recipe is a number in a mixed base: a digit for each spot, which counts the causes that are
    still free there. Unique recipes take their numbers from a keyed permutation of all there are,
    so that none repeats and no row waits for another; if there are more than ``permute.MOST``,
    the leading spots alone are numbered so, and the others are drawn. ``attempts`` is accepted
    for callers of the earlier rounds of drawing; nothing is drawn twice now."""
    n = causes.count()
    if not 0 < arity <= n:
        raise ValueError("arity must be positive and at most the number of causes")
    bases = [n if replacement else n - k for k in range(arity)]
    digits = [stable_index(seed, "draw", F.col("relation_index").cast("string"), 0, k) % base for k, base in enumerate(bases)]
    if unique:
        lead, space = 0, 1
        while lead < arity and space * bases[lead] <= permute.MOST:
            space, lead = space * bases[lead], lead + 1
        least, most = effects.agg(F.min("relation_index"), F.max("relation_index")).first()
        if most is not None and not 0 <= least <= most < space:
            raise RuntimeError("recipes repeat: too few causes for unique recipes")
        below = 1
        for k in range(lead):
            digits[k] = F.call_function("div", F.col("_rank"), F.lit(below)) % bases[k]
            below *= bases[k]
        effects = effects.select("relation_index", permute.permuted(F.col("relation_index"), space, seed, "draw").alias("_rank"))
    taken = effects.withColumns({f"_{k}": d for k, d in enumerate(digits)})
    if not replacement:  # the digit-th free cause: past every smaller one that is taken
        for k in range(1, arity):
            before = F.sort_array(F.array(*[F.col(f"_{j}") for j in range(k)]))
            taken = taken.withColumn(f"_{k}", F.aggregate(before, F.col(f"_{k}"), lambda c, p: F.when(c >= p, c + 1).otherwise(c)))
    taken = taken.select("relation_index", F.array(*[F.col(f"_{k}") for k in range(arity)]).alias("_i"))
    spots = taken.select("relation_index", F.posexplode("_i").alias("position", "cause_index"))
    named = spots.join(causes.select("cause_index", "cause_id"), "cause_index")
    return named.groupBy("relation_index").agg(F.sort_array(F.collect_list(F.struct("position", "cause_id"))).alias("r")).select(
        "relation_index", F.col("r.cause_id").alias("recipe")
    )


def relations(effects: DataFrame, causes: DataFrame, recipes: DataFrame) -> DataFrame:
    """``effects`` (relation_index, effect_id, surface, family, partition) with the recipe of
    each, from ``recipes`` (relation_index, position, cause_id)."""
    spots = recipes.join(causes.select("cause_id", "surface"), "cause_id")
    spot = F.struct("position", "cause_id", "surface")
    whole = spots.groupBy("relation_index").agg(F.sort_array(F.collect_list(spot)).alias("r"))
    recipe = F.transform("r", lambda x: F.struct(x.cause_id.alias("cause_id"), x.surface.alias("surface")))
    return effects.join(whole, "relation_index").select(
        "relation_index", "effect_id", F.col("surface").alias("effect_surface"), recipe.alias("recipe"),
        F.col("r.cause_id").alias("recipe_cause_ids"), "partition", "family",
    )


# -- audit ----------------------------------------------------------------------------


def cause_usage(relations_: DataFrame, causes: DataFrame) -> DataFrame:
    """One row: min_used, max_used, used_causes, unused_causes."""
    used = relations_.select(F.explode("recipe_cause_ids").alias("cause_id")).groupBy("cause_id").agg(F.count("*").alias("n"))
    stats = used.agg(
        F.coalesce(F.min("n"), F.lit(0)).alias("min_used"), F.coalesce(F.max("n"), F.lit(0)).alias("max_used"), F.count("*").alias("used_causes")
    )
    return stats.crossJoin(causes.agg(F.count("*").alias("_all"))).select(  # one row on either side
        "min_used", "max_used", "used_causes", (F.col("_all") - F.col("used_causes")).alias("unused_causes")
    )


def duplicate_recipes(relations_: DataFrame) -> DataFrame:
    """One row: num_relations, distinct_recipes, duplicate_recipe_tuples."""
    per = relations_.groupBy("recipe_cause_ids").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_relations"), F.count("*").alias("distinct_recipes")).withColumn(
        "duplicate_recipe_tuples", F.col("num_relations") - F.col("distinct_recipes")
    )


def recipe_overlap(relations_: DataFrame, pairs: int = 10_000) -> DataFrame:
    """One row over the first ``pairs`` neighbours in order: sampled_pairs, max_overlap,
    mean_overlap. A neighbour is found by rank, so at most pairs + 1 rows are ordered."""
    head = relations_.select("relation_index", "recipe_cause_ids").orderBy("relation_index").limit(pairs + 1)
    after = F.lead("recipe_cause_ids").over(Window.partitionBy(F.lit(0)).orderBy("relation_index"))
    shared = head.withColumn("b", after).filter("b IS NOT NULL").select(F.size(F.array_intersect("recipe_cause_ids", "b")).alias("k"))
    return shared.agg(
        F.count("*").alias("sampled_pairs"),
        F.coalesce(F.max("k"), F.lit(0)).alias("max_overlap"),
        F.coalesce(F.avg("k"), F.lit(0.0)).alias("mean_overlap"),
    )
