"""World queries over the generated tables: parts are effects, suppliers are causes, and a
part's recipe are the suppliers of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import permute, vocab
from tessella.operators import world
from tessella.plans import sql

SEED = 13
RESTRICTED = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("relation_index"), world.formatted_id("E", F.col("p_partkey")).alias("effect_id"),
        F.col("p_name").alias("surface"), F.col("p_brand").alias("family"),
    )


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cause_index"), world.formatted_id("C", F.col("s_suppkey")).alias("cause_id"), F.col("s_name").alias("surface")
    )


EFFECTS_SQL = "SELECT p_partkey AS relation_index, format('E{:06d}', p_partkey) AS effect_id, p_name AS surface, p_brand AS family FROM part"
CAUSES_SQL = "SELECT s_suppkey AS cause_index, format('C{:06d}', s_suppkey) AS cause_id, s_name AS surface FROM supplier"


def recipes(spark: SparkSession, sf_dir: str, arity: int) -> DataFrame:
    """(relation_index, position, cause_id): the part's smallest suppliers."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    if arity == 1:
        first = pairs.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey")).withColumn("position", F.lit(0).cast("bigint"))
    else:
        place = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1
        first = pairs.withColumn("position", place.cast("bigint")).filter(F.col("position") < arity)
    return first.select(F.col("l_partkey").alias("relation_index"), "position", world.formatted_id("C", F.col("l_suppkey")).alias("cause_id"))


def relations(spark: SparkSession, sf_dir: str, arity: int = 1) -> DataFrame:
    parted = world.partition_random(effects(spark, sf_dir), RESTRICTED, SEED)
    return world.relations(parted, causes(spark, sf_dir), recipes(spark, sf_dir, arity))




_PART_ORDER = sql.stable_index(SEED, "partition", sql.Raw(sql.js("effect_id")))
PARTED_SQL = f"""
SELECT relation_index, effect_id, surface, family,
       CASE WHEN row_number() OVER (ORDER BY h, effect_id) <= round_even((count(*) OVER ())::DOUBLE * {RESTRICTED}, 0) THEN 'restricted' ELSE 'open' END AS partition
FROM (SELECT *, {_PART_ORDER} AS h FROM ({EFFECTS_SQL}))
"""


def recipes_sql(arity: int) -> str:
    return f"""
SELECT l_partkey AS relation_index, r - 1 AS position, format('C{{:06d}}', l_suppkey) AS cause_id
FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r
      FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) WHERE r <= {arity}
"""


def relations_sql(arity: int = 1) -> str:
    """Relations with recipe as a list of {{cause_id, surface}}."""
    return f"""
SELECT p.relation_index, effect_id, p.surface AS effect_surface, list({{'cause_id': r.cause_id, 'surface': c.surface}} ORDER BY position) AS recipe,
       list(r.cause_id ORDER BY position) AS recipe_cause_ids, partition, family
FROM ({PARTED_SQL}) AS p JOIN ({recipes_sql(arity)}) AS r USING (relation_index) JOIN ({CAUSES_SQL}) AS c ON c.cause_id = r.cause_id
GROUP BY p.relation_index, effect_id, p.surface, partition, family
"""


def _joined(column) -> F.Column:
    return F.array_join(column, "|")


def world_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).select(
        "relation_index", "effect_id", "effect_surface", _joined("recipe_cause_ids").alias("causes"),
        _joined(F.transform("recipe", lambda x: x.surface)).alias("cause_surfaces"), "partition", "family",
    )


def partition_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.partition_random(effects(spark, sf_dir), RESTRICTED, SEED).select("effect_id", "partition")


def partition_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.partition_by_family(effects(spark, sf_dir), 0.3, SEED).select("effect_id", "family", "partition")


def splits_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.splits(world.partition_random(effects(spark, sf_dir), RESTRICTED, SEED))


def recipe_balanced_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.balanced_recipes(effects(spark, sf_dir), causes(spark, sf_dir), 2, SEED, unique=False)


def recipe_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = world.drawn_recipes(effects(spark, sf_dir), causes(spark, sf_dir), 2, SEED, replacement=True, unique=False)
    return drawn.select("relation_index", _joined("recipe").alias("causes"))


def recipe_unique_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = world.drawn_recipes(effects(spark, sf_dir), causes(spark, sf_dir), 3, SEED)
    return drawn.select("relation_index", _joined("recipe").alias("causes"))


def world_audit_cause_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.cause_usage(relations(spark, sf_dir, 2), causes(spark, sf_dir))


def recipe_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.duplicate_recipes(relations(spark, sf_dir))


def recipe_overlap_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.recipe_overlap(relations(spark, sf_dir, 3))


def vocab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = world.vocabulary_overlap(causes(spark, sf_dir), effects(spark, sf_dir))
    return found.select("kind", _joined("words").alias("words"))


def allowed_surface_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(vocab.surface_words(F.col("text"))).alias("word")).distinct()
    return words.filter(vocab.allowed_surface(F.col("word"))).select("word")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("value"))


def eligible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.eligible_words(_dictionary(spark, sf_dir), F.length("word").cast("bigint"))


def rank_skip_topk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.ranked_words(eligible_words(spark, sf_dir), 100, 20)


def generated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(5000)
    return rows.select(F.col("id").alias("index"), *[vocab.generated_word(F.col("id"), s).alias(f"salt_{s}") for s in (0, 11, 41)])


def effect_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.effect_grid(spark, 3000).filter(vocab.allowed_surface(F.col("surface"))).select("index", "surface")


_SYL = "[" + ", ".join(f"'{s}'" for s in vocab.SYLLABLES) + "]"
_BARRED = "[" + ", ".join(f"'{w}'" for w in sorted({*vocab.META_TOKENS, *vocab.HARMFUL_TERMS})) + "]"


def _word_sql(index: str, salt: int) -> str:
    v = f"({index} + {salt * vocab.SALT_STEP})"
    own = f"list_transform(list_filter(range(0, 12), lambda k: {v} >= power(34, k)::BIGINT), lambda k: ({_SYL})[({v} // power(34, k)::BIGINT) % 34 + 1])"
    digits = f"len(list_filter(range(0, 12), lambda k: {v} >= power(34, k)::BIGINT))"
    more = f"list_transform(list_filter(range(0, 2), lambda k: k >= {digits}), lambda k: ({_SYL})[({index} + k + {salt}) % 34 + 1])"
    return f"array_to_string(list_concat({own}, {more}), '')"


_P, _N = len(vocab.EFFECT_PREFIXES), len(vocab.EFFECT_NOUNS)
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"
_STOPS = "[" + ", ".join(f"'{w}'" for w in sorted({*vocab.STOPWORDS, *vocab.META_TOKENS, *vocab.HARMFUL_TERMS})) + "]"

ELIGIBLE_SQL = f"""
SELECT DISTINCT word, length(word)::BIGINT AS rank
FROM (SELECT lower(split_part(value, '/', 1)) AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS value FROM documents))
WHERE length(word) BETWEEN 6 AND 12 AND regexp_full_match(word, '[a-z]+') AND NOT list_contains({_STOPS}, word)
"""

_DECK = sql.stable_index(SEED, "deck", sql.Raw(sql.num("epoch")), sql.Raw(sql.js("cause_id")))


def _draw_sql(k: int) -> str:
    at = sql.stable_index(SEED, "draw", sql.Raw(sql.num("relation_index")), 0, sql.Raw(f"'{k}'"))
    return f"(SELECT cause_id FROM c WHERE cause_index = ({at}) % (SELECT count(*) FROM c))"


_PLACES = "SELECT count(*) * (count(*) - 1) * (count(*) - 2) FROM supplier"
UNIQUE_SQL = f"""
WITH c AS ({CAUSES_SQL}), d AS (
    SELECT relation_index, place % n AS a, place // n % (n - 1) AS b, place // (n * (n - 1)) % (n - 2) AS c
    FROM ({permute.permuted_sql(EFFECTS_SQL, "relation_index", _PLACES, SEED, "draw")}), (SELECT count(*) AS n FROM supplier)
), two AS (SELECT relation_index, a, b + (b >= a)::INT AS b, c FROM d),
three AS (SELECT relation_index, a, b, c + (c >= least(a, b))::INT AS c FROM two),
spots AS (SELECT relation_index, unnest([a, b, c + (c >= greatest(a, b))::INT]) AS cause_index, unnest([0, 1, 2]) AS position FROM three)
SELECT relation_index, string_agg(cause_id, '|' ORDER BY position) AS causes FROM spots JOIN c USING (cause_index) GROUP BY relation_index"""

QUERIES = {
    f.__name__: f
    for f in (
        world_relations, partition_random, partition_family, splits_collect, recipe_balanced_assign, recipe_drawn, recipe_unique_draws,
        world_audit_cause_usage, recipe_duplicates, recipe_overlap_adjacent, vocab_overlap, allowed_surface_filter, eligible_words,
        rank_skip_topk_words, generated_words, effect_grid,
    )
}

ORACLES = {
    "world_relations": f"""
SELECT relation_index, effect_id, effect_surface, array_to_string(recipe_cause_ids, '|') AS causes,
       array_to_string(list_transform(recipe, lambda x: x.surface), '|') AS cause_surfaces, partition, family FROM ({relations_sql()})""",
    "partition_random": f"SELECT effect_id, partition FROM ({PARTED_SQL})",
    "partition_family": f"""
WITH e AS ({EFFECTS_SQL}), f AS (
    SELECT family, {sql.stable_index(SEED, "family", sql.Raw(sql.js("family")))} AS h FROM (SELECT DISTINCT family FROM e WHERE family <> '')
), r AS (SELECT family, row_number() OVER (ORDER BY h, family) <= round_even((count(*) OVER ())::DOUBLE * 0.3, 0) AS hit FROM f)
SELECT effect_id, family, CASE WHEN hit THEN 'restricted' ELSE 'open' END AS partition FROM e LEFT JOIN r USING (family)""",
    "splits_collect": f"SELECT partition, row_number() OVER (PARTITION BY partition ORDER BY effect_id) - 1 AS place, effect_id FROM ({PARTED_SQL})",
    "recipe_balanced_assign": f"""
WITH e AS ({EFFECTS_SQL}), c AS ({CAUSES_SQL}), s AS (SELECT count(*) // 2 AS slots FROM c),
ep AS (SELECT DISTINCT relation_index // slots AS epoch FROM e, s),
d AS (SELECT epoch, cause_id, row_number() OVER (PARTITION BY epoch ORDER BY {_DECK}, cause_id) - 1 AS place FROM ep, c)
SELECT (epoch * slots + place // 2)::BIGINT AS relation_index, (place % 2)::BIGINT AS position, cause_id
FROM d, s WHERE place < slots * 2 AND (epoch * slots + place // 2) IN (SELECT relation_index FROM e)""",
    "recipe_drawn": f"WITH e AS ({EFFECTS_SQL}), c AS ({CAUSES_SQL}) SELECT relation_index, concat({_draw_sql(0)}, '|', {_draw_sql(1)}) AS causes FROM e",
    "recipe_unique_draws": UNIQUE_SQL,
    "world_audit_cause_usage": f"""
WITH u AS (SELECT cause_id, count(*) AS n FROM (SELECT unnest(recipe_cause_ids) AS cause_id FROM ({relations_sql(2)})) GROUP BY 1)
SELECT coalesce(min(n), 0)::BIGINT AS min_used, coalesce(max(n), 0)::BIGINT AS max_used, count(*)::BIGINT AS used_causes,
       ((SELECT count(*) FROM supplier) - count(*))::BIGINT AS unused_causes FROM u""",
    "recipe_duplicates": f"""
SELECT count(*)::BIGINT AS num_relations, count(DISTINCT recipe_cause_ids)::BIGINT AS distinct_recipes,
       (count(*) - count(DISTINCT recipe_cause_ids))::BIGINT AS duplicate_recipe_tuples FROM ({relations_sql()})""",
    "recipe_overlap_adjacent": f"""
WITH r AS (SELECT relation_index, recipe_cause_ids AS a FROM ({relations_sql(3)}) ORDER BY relation_index LIMIT 10001),
p AS (SELECT a, lead(a) OVER (ORDER BY relation_index) AS b FROM r)
SELECT count(*)::BIGINT AS sampled_pairs, max(len(list_intersect(a, b)))::INTEGER AS max_overlap, avg(len(list_intersect(a, b)))::DOUBLE AS mean_overlap
FROM p WHERE b IS NOT NULL""",
    "vocab_overlap": f"""
WITH cs AS (SELECT DISTINCT s_name AS w FROM supplier), es AS (SELECT DISTINCT p_name AS w FROM part),
cw AS (SELECT DISTINCT unnest({_WORDS.format(x="s_name")}) AS w FROM supplier), ew AS (SELECT DISTINCT unnest({_WORDS.format(x="p_name")}) AS w FROM part),
m AS (SELECT unnest([{", ".join(f"'{w}'" for w in vocab.META_TOKENS)}]) AS w), h AS (SELECT unnest([{", ".join(f"'{w}'" for w in vocab.HARMFUL_TERMS)}]) AS w),
a AS (SELECT 'cause_effect_surface' AS kind, w FROM cs WHERE w IN (FROM es) UNION ALL SELECT 'cause_effect_word', w FROM cw WHERE w IN (FROM ew)
      UNION ALL SELECT 'cause_meta_word', w FROM cw WHERE w IN (FROM m) UNION ALL SELECT 'effect_meta_word', w FROM ew WHERE w IN (FROM m)
      UNION ALL SELECT 'cause_harmful_word', w FROM cw WHERE w IN (FROM h) UNION ALL SELECT 'effect_harmful_word', w FROM ew WHERE w IN (FROM h))
SELECT kind, coalesce(string_agg(w, '|' ORDER BY w), '') AS words
FROM (SELECT unnest(['cause_effect_surface', 'cause_effect_word', 'cause_meta_word', 'effect_meta_word', 'cause_harmful_word', 'effect_harmful_word']) AS kind)
LEFT JOIN a USING (kind) GROUP BY kind""",
    "allowed_surface_filter": f"""
SELECT word FROM (SELECT DISTINCT unnest({_WORDS.format(x="text")}) AS word FROM documents) WHERE NOT list_contains({_BARRED}, word)""",
    "eligible_words": ELIGIBLE_SQL,
    "rank_skip_topk_words": f"SELECT * FROM ({ELIGIBLE_SQL}) ORDER BY rank, word LIMIT 100 OFFSET 20",
    "generated_words": f"SELECT i AS index, {', '.join(f'{_word_sql("i", s)} AS salt_{s}' for s in (0, 11, 41))} FROM range(0, 5000) AS r(i)",
    "effect_grid": f"""
WITH g AS (
    SELECT i AS index, concat(({list(vocab.EFFECT_PREFIXES)})[i % {_P} + 1], ' ', ({list(vocab.EFFECT_NOUNS)})[(i // {_P}) % {_N} + 1],
           CASE WHEN i // {_P * _N} = 0 THEN '' ELSE concat(' ', {_word_sql(f"(i // {_P * _N})", 41)}) END) AS surface
    FROM range(0, 3000) AS r(i))
SELECT index, surface FROM g WHERE NOT list_has_any(string_split(surface, ' '), {_BARRED})""",
}
