"""Constraints as violation tables: each check returns the rows that break it, so a sound table gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """Rows that break any named rule, with the names; a null outcome breaks no rule, as in a database check."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def all_or_none(*columns: str) -> Column:
    n = non_null(*columns)
    return (n == 0) | (n == len(columns))


def exactly_one(*columns: str) -> Column:
    return non_null(*columns) == 1


def non_null(*columns: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def sha256_text(column: str) -> Column:
    return F.col(column).rlike("^[0-9a-f]{64}$")
