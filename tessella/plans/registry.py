"""Every registered query of the engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import builds, corpora, logs, scoring, worlds

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (worlds, corpora, scoring, logs, builds):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
