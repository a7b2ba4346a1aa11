"""Readers and writers of row data: JSON lines, JSON documents, word lists, token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import vocab
from tessella.sources import files

DICTIONARIES = ("/usr/share/dict/words", "/usr/share/dict/american-english", "/usr/share/hunspell/en_US.dic")

RECIPE = "array<struct<cause_id string, surface string>>"
RELATION_SCHEMA = (
    f"effect_id string, effect_surface string, recipe {RECIPE}, recipe_cause_ids array<string>, partition string, family string"
)
CAUSE_SCHEMA = "cause_id string, surface string"
EFFECT_SCHEMA = "effect_id string, surface string, family string"
METADATA = (
    "world_id string, relation_id string, partition string, family string, pattern string, direction string, stage string, split string, "
    "sample_index bigint, template_key struct<family string, pattern string, template_index bigint, stage string>, template_key_hash string, "
    "answer_text string, answer_ids array<string>, recipe_cause_ids array<string>, effect_id string, qa_type string, "
    "unsafe_direct_reverse boolean, b_conditioned_cause_signal boolean, normal_direct_reverse boolean"
)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON file that holds one object or one array of objects."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines with a declared schema, so that columns are pruned; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def _sorted_keys(column: Column, kind: T.DataType) -> Column:
    """The column with the fields of its structs, at any depth, in order of name."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        own = F.struct(*[_sorted_keys(column.getField(f.name), f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), own)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(column, lambda x: _sorted_keys(x, kind.elementType))
    return column


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, compression: str | None = None) -> int:
    """Rows as JSON lines, keys sorted, nulls written out; how many. With ``partition_by``
    rows are routed to a folder each, in the one pass. Lines are plain unless ``compression``
    names one of Spark's codecs, which readers tell by the files' names."""
    keys = set(partition_by or [])
    fields = sorted((f for f in df.schema.fields if f.name not in keys), key=lambda f: f.name)
    seen = Observation()
    rows = df.select(*[_sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields], *keys)
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False)
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return seen.get["n"]


def jsonl_field(line: Column, field: str = "text") -> Column:
    """One top-level field of a JSON line, without parsing the rest into columns."""
    return F.get_json_object(line, f"$.{field}")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations with relation_index, which the id carries."""
    index = F.regexp_extract("effect_id", r"(\d+)\z", 1).cast("bigint")
    return read_jsonl(spark, path, RELATION_SCHEMA).withColumn("relation_index", index)


def dictionary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(value): lines of a word list, without possessives, hyphens and phrases. The given
    file, else the usual places, else a few built-in words."""
    found = [p for p in ([path] if path and path.lower() not in ("none", "null") else DICTIONARIES) if files.exists(spark, p)]
    if not found:
        return spark.createDataFrame([(w,) for w in vocab.FALLBACK_WORDS], "value string")
    word = F.split_part(F.trim("value"), F.lit("/"), F.lit(1))
    return spark.read.text(found).select(word.alias("value")).filter(~F.col("value").rlike(r"['\- ]"))


def write_blocks(blocks: DataFrame, path: str, info: dict, mode: str = "errorifexists") -> None:
    """Token blocks as Parquet by split, and metadata.json with the counts."""
    blocks.write.mode(mode).partitionBy("split").parquet(f"{path}/blocks")
    spark = blocks.sparkSession
    counts = {r.split: r["count"] for r in spark.read.parquet(f"{path}/blocks").groupBy("split").count().collect()}
    files.write_json(spark, f"{path}/metadata.json", {**info, "splits": counts})


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Token blocks; a train split is required."""
    blocks = spark.read.parquet(f"{path}/blocks")
    if "split" not in blocks.columns:
        return blocks.withColumn("split", F.lit("train"))
    if blocks.filter("split = 'train'").isEmpty():
        raise ValueError(f"{path} has no train split")
    return blocks


def block_size(spark: SparkSession, path: str) -> int:
    """From the metadata if it says so, else the length of any block."""
    if files.exists(spark, f"{path}/metadata.json"):
        known = int(files.read_json(spark, f"{path}/metadata.json").get("block_size") or 0)
        if known > 0:
            return known
    first = read_blocks(spark, path).select(F.size("input_ids").alias("n")).first()
    if first is None:
        raise ValueError(f"{path} has no blocks")
    return first.n


def eval_split(blocks: DataFrame) -> str | None:
    """The first of validation, valid and eval that exists."""
    have = {r.split for r in blocks.select("split").distinct().collect()}  # a handful of names
    return next((s for s in ("validation", "valid", "eval") if s in have), None)


def question_splits(spark: SparkSession, train: str, validation: str | None, schema: str) -> DataFrame:
    """Question rows with ``split``; a validation file that is absent or empty is left out."""
    if not files.exists(spark, train):
        raise FileNotFoundError(train)
    rows = read_jsonl(spark, train, schema).withColumn("split", F.lit("train"))
    if validation and files.size(spark, validation):
        rows = rows.unionByName(read_jsonl(spark, validation, schema).withColumn("split", F.lit("validation")))
    return rows


def require_columns(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``rows``, if it has the columns."""
    if gone := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return rows


def concatenated(spark: SparkSession, sources: dict[str, list[str]], schema: str, corrupt: str | None = None) -> DataFrame:
    """Rows of all files of each split, with ``split`` and ``source``, the place of the file or
    folder, by one scan: a row's file tells its sources. A path that is listed twice gives its
    rows twice. With ``corrupt``, a line that is no JSON object is kept in a column of that name."""
    places = [(f, split, k) for split, paths in sources.items() for k, path in enumerate(paths) for f in files.below(spark, path)]
    paths = sorted({path for held in sources.values() for path in held})
    if not paths:
        raise ValueError("no sources")
    if gone := [p for p in paths if not files.exists(spark, p)]:
        raise FileNotFoundError(", ".join(gone))
    reader = spark.read.schema(schema if corrupt is None else f"{schema}, {corrupt} string")
    if corrupt is not None:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    # folders inside a source are walked into, but do not become columns
    rows = reader.option("recursiveFileLookup", True).json(paths)
    own = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), files.SCHEME, "/")
    listed = F.broadcast(spark.createDataFrame(places, "_file string, split string, source int"))  # a row for each file that the driver lists
    return rows.withColumn("_file", own).join(listed, "_file").drop("_file")
