"""The engine's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import indexed, relational


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on an indexed key."""
    return indexed.queries()["btree_range"](spark, sf_dir)


def queries() -> dict:
    return indexed.queries() | relational.queries()


def oracle_sql() -> dict:
    return indexed.oracle_sql() | relational.oracle_sql()
