"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.plans import evaluation, general, geometry, preparation, results, scoring, storage

_MODULES = [general, evaluation, preparation, scoring, results, geometry, storage]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["e_mode1"](spark, folder)
