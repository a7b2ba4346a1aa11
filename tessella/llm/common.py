"""What several training-data operators share: table access, materialised
intermediates, and co-locating each row with its successor in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.scratch import materialise, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_below(h: Column, wanted: int, rows: int) -> Column:
    """Keeps about ``wanted`` of ``rows`` rows, by their 64-bit hash ``h`` alone; nothing
    else is needed to draw a sample, so only the drawn rows ever leave their tasks."""
    if wanted >= rows:
        return F.lit(True)
    return h < F.lit(-(1 << 63) + ((wanted << 64) // rows))


#: Bytes of an Arrow batch of texts, where the default is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise_texts(df: DataFrame) -> DataFrame:
    """``materialise`` for what Python makes of texts: Arrow batches are ``BATCH_BYTES`` long
    while it runs, so that a worker's memory follows neither the number of rows nor, but for
    a single text, their length."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH, None)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return materialise(df)
    finally:
        conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)


#: Bytes of rows that ``with_successors`` aims at in a range, and the most ranges it makes.
RANGE_BYTES, RANGES = 64 << 20, 16_384
_PART = "\x02"


def _bucket(key: Column, held: Column, count: int) -> Column:
    """Number of the ``count`` sorted bounds at or below key, by binary search in a constant array."""
    if not count:
        return F.lit(0)
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        below = key < F.get(held, mid)
        return F.when(s.lo >= s.hi, s).when(below, span(s.lo, mid)).otherwise(span(mid + 1, s.hi))

    steps = F.sequence(F.lit(1), F.lit(count.bit_length()))
    return F.aggregate(steps, span(F.lit(0), F.lit(count)), halve, lambda s: s.lo)


def with_successors(
    df: DataFrame,
    key: Column,
    order: list[str],
    wrap: bool,
    size: Column,
    per_bound: int = 24,
    barred: DataFrame | None = None,
) -> DataFrame:
    """Range-partition ``df`` by ``key`` (a long or a string) so that every row shares a task, in
    order, with the row after it.

    Adds ``_bucket`` int and ``_ahead`` boolean. Within a partition rows come sorted
    by (_bucket, _ahead, _key, *order). A row whose key is a bucket's lower bound is
    sent to the bucket before as well, marked ``_ahead``: the first such row there
    is the successor of that bucket's last own row. With ``wrap`` the smallest key
    is sent, marked, to the last bucket too. The rows are shuffled once, whatever
    the number of buckets; a bound is a key of the data, drawn from a sample of about
    ``per_bound`` keys a bucket, and only decides how even the buckets are. There are
    enough for ``RANGE_BYTES`` of rows (by ``size``) each, up to ``RANGES``; the bounds
    travel as one constant. Rows of one key are one bucket, which a task streams through.
    Keys in ``barred`` (_key) never become bounds. Null keys must have been replaced by
    the caller.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", key)
    keys = keyed.select("_key")
    least, rows, held = keyed.agg(F.min("_key"), F.count("*"), F.sum(size)).first()
    by_bytes = -(-(held or 0) // RANGE_BYTES)
    buckets = min(max(2 * partitions(spark), by_bytes), RANGES)
    drawn = keys.filter(hash_below(F.xxhash64("_key"), buckets * per_bound, rows)).distinct()
    if barred is not None:
        drawn = drawn.join(barred, "_key", "left_anti")
    sample = [r[0] for r in drawn.collect()]
    distinct = sorted({k for k in sample if k != least and _PART not in str(k)})
    step = max(1, -(-len(distinct) // buckets))
    bounds = distinct[step // 2 :: step]
    kind = keyed.schema["_key"].dataType.simpleString()
    constant = F.split(F.lit(_PART.join(map(str, bounds))), _PART).cast(f"array<{kind}>")
    own = _bucket(F.col("_key"), constant, len(bounds))
    place = lambda b, ahead: F.struct(b.cast("int").alias("_bucket"), F.lit(ahead).alias("_ahead"))
    homes = F.array(place(F.col("_own"), False))
    if bounds:
        homes = F.when(
            F.get(constant, F.col("_own") - 1) == F.col("_key"),
            F.array(place(F.col("_own"), False), place(F.col("_own") - 1, True)),
        ).otherwise(homes)
    if wrap and least is not None:
        homes = F.when(
            F.col("_key") == F.lit(least),
            F.array(place(F.col("_own"), False), place(F.lit(len(bounds)), True)),
        ).otherwise(homes)
    placed = keyed.withColumn("_own", own).withColumn("_home", F.explode(homes)).select(*keyed.columns, "_home.*")
    dealt = placed.repartition(int(by_bytes), "_bucket") if by_bytes > partitions(spark) else placed.repartition("_bucket")
    return dealt.sortWithinPartitions("_bucket", "_ahead", "_key", *order)


__all__ = ["hash_below", "materialise", "materialise_texts", "partitions", "scratch_dir", "table", "with_successors"]
