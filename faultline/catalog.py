"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import registered, registered_more


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered.QUERIES["j01_regressions"](spark, sf_dir)


assert registered_more.register is registered.register  # both modules fill one registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registered.SQL)
