"""The registered queries of the ledger engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import actuals, boundaries, corrections, documents, facts, finance, history, listings, mentions, notices, outlines, pages, placement, places, records, tenders

MODULES: tuple[ModuleType, ...] = (tenders, finance, history, documents, places, pages, notices, mentions, records, facts, corrections, boundaries, actuals, listings, placement, outlines)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenders.counts_by_district(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
