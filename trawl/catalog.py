"""All queries of the engine, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawl import core_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core_queries.ORACLES)
