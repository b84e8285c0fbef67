"""Named queries over the driver's tables, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, scoring, selection, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (texts, selection, scoring, extraction):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fallback_select"](spark, sf_dir)
