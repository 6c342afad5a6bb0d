"""Guards: tables of violations, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """Rows that a guard doesn't let pass."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples if there are any rows."""
    found = violations.limit(3).collect()
    if found:
        raise GuardError(f"{what}: {[r.asDict() for r in found]}")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules))


def identity(df: DataFrame, *columns: str) -> DataFrame:
    """(n_distinct, ok): whether all rows agree in the columns."""
    return df.agg(F.countDistinct(F.struct(*columns)).alias("n_distinct")).withColumn("ok", F.col("n_distinct") <= 1)


def differing(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose rows differ in a column."""
    return df.groupBy(key).agg(F.min(column).alias("low"), F.max(column).alias("high")).filter(~F.col("low").eqNullSafe(F.col("high")))
