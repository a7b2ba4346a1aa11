"""Materialised intermediates in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: spark.checkpoint.dir where it is set,
    else (local sessions, tests) a folder of our own, and on a cluster without the
    setting a folder under the warehouse, which every executor can see."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="tessella-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared checkpoint folder, so a lost executor
    costs no recomputation and reuse costs no second run of what made them."""
    spark = df.sparkSession
    where = scratch_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)
