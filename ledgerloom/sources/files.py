"""Readers and writers of the ledger's files: CSV directories, JSON records and pages, review sheets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted CSV with a header, doubled quotes and line breaks inside fields; blank rows go."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in rows.columns]).isNotNull())


def directory(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their ledger names, found whatever their case; a name with no column is an error."""
    have = {c.lower().replace(" ", "").replace("_", ""): c for c in rows.columns}
    out = []
    for name, spellings in wanted.items():
        found = next((have[s.lower().replace(" ", "").replace("_", "")] for s in spellings if s.lower().replace(" ", "").replace("_", "") in have), None)
        if found is None:
            raise ValueError(f"no column for {name}: expected one of {spellings}")
        out.append(F.trim(F.col(f"`{found}`").cast("string")).alias(name))
    return rows.select(*out)


def split_rejects(rows: DataFrame, **reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with the first reason that holds."""
    reason = None
    for text, condition in reasons.items():
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """Records of multi-line JSON documents, or of one array field of each."""
    rows = spark.read.schema(f"{field} array<struct<{schema}>>" if field else schema).option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("r")).select("r.*") if field else rows


def write_sheet(rows: DataFrame, path: str) -> None:
    """A fully quoted CSV sheet with doubled quotes."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def as_json_rows(rows: DataFrame, order: str) -> DataFrame:
    """Every row as a JSON text, keyed by its order column: the record set that another ledger loads."""
    return rows.select(F.col(order).alias("place"), F.to_json(F.struct(*rows.columns)).alias("record"))


def from_json_rows(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("record", schema).alias("r")).select("r.*")


#: Counters of one page of metrics.
MOST_COUNTERS = 10_000


def metrics_text(rows: DataFrame) -> str:
    """Counters (name, value) in exposition format, sorted by name; more than MOST_COUNTERS are refused, as one page can't hold them."""
    found = rows.orderBy("name").limit(MOST_COUNTERS + 1).collect()
    if len(found) > MOST_COUNTERS:
        raise ValueError(f"more than {MOST_COUNTERS} counters")
    lines = [f"{r['name']} {r['value']}" for r in found]
    return "\n".join(lines) + "\n"
