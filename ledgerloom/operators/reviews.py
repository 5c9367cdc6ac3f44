"""Review of facts and their promotion to another ledger: decisions and revisions, readings still awaited, reserved ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names that identify nobody.
NOBODY = ("me", "admin", "user", "test", "unknown", "none")
#: Ids that share a bucket when ids are reserved.
BUCKET = 100_000


def refusal(kind: Column, decision: Column, reviewer: Column, value: Column, note: Column) -> Column:
    """Why a decision can't be taken as submitted, or null: the first of reviewer, reason of a revision, corrected value."""
    who, given = F.trim(F.coalesce(reviewer, F.lit(""))), F.trim(F.coalesce(value, F.lit(""))) != ""
    return (
        F.when((F.length(who) < 3) | F.lower(who).isin(*NOBODY), "no_reviewer")
        .when((kind == "revise") & (F.trim(F.coalesce(note, F.lit(""))) == ""), "no_reason")
        .when((decision == "corrected") & ~given, "no_value")
        .when((decision != "corrected") & given, "value_without_correction")
    )


def outcomes(submitted: DataFrame) -> DataFrame:
    """submitted: id (their order), fact_id, kind, decision, reviewer, value, note. Adds outcome.

    The first sound record of a fact decides it; a revision needs an earlier one. A fact's first one is an aggregate
    that joins back, so that a fact with very many decisions is no single task's work.
    """
    checked = submitted.withColumn("refusal", refusal(*[F.col(c) for c in ("kind", "decision", "reviewer", "value", "note")]))
    first = checked.where("refusal IS NULL AND kind = 'record'").groupBy("fact_id").agg(F.min("id").alias("_first"))
    rows = checked.join(first, "fact_id", "left")
    recorded = F.when(F.col("id") == F.col("_first"), "recorded").otherwise("already_decided")
    revised = F.when(F.col("_first") < F.col("id"), "revised").otherwise("not_decided")
    return rows.withColumn("outcome", F.coalesce("refusal", F.when(F.col("kind") == "record", recorded).otherwise(revised))).drop("_first", "refusal")


def pages_awaiting(pages: DataFrame, readings: DataFrame, engines: list[str]) -> DataFrame:
    """Pages (document_id, page_number) that some engine has not read, with those engines; a refusal is no reading."""
    wanted = F.array(*[F.lit(e) for e in engines])
    read = readings.where("refusal IS NULL").groupBy("document_id", "page_number").agg(F.collect_set("engine").alias("_read"))
    rows = pages.join(read, ["document_id", "page_number"], "left")
    missing = F.array_except(wanted, F.coalesce("_read", F.array().cast("array<string>")))
    return rows.withColumn("awaited", missing).where("size(awaited) > 0").drop("_read")


def reserved(rows: DataFrame, key: str, start: int) -> DataFrame:
    """(key, new_id): consecutive ids from ``start`` in the order of a unique integer key.

    Ranks are counted inside buckets of BUCKET neighbouring keys, and sizes summed bucket by bucket in three steps, each
    a hundred thousand times as wide: no window holds more than BUCKET rows, whatever the keys.
    """
    wide = [F.floor(F.col(key) / BUCKET), F.floor(F.col(key) / BUCKET**2), F.floor(F.col(key) / BUCKET**3)]
    dealt = rows.select(key, *(w.alias(f"_b{i}") for i, w in enumerate(wide)))
    places = dealt.select(key, "_b0", (F.row_number().over(W.partitionBy("_b0").orderBy(key)) - 1).alias("_place"))
    sizes = dealt.groupBy("_b0", "_b1", "_b2").agg(F.count("*").alias("_n"))
    for i in range(3):
        inside = W.partitionBy(f"_b{i + 1}").orderBy(f"_b{i}") if i < 2 else W.orderBy("_b2")
        step = sizes if i == 0 else sizes.groupBy(*(f"_b{j}" for j in range(i, 3))).agg(F.sum("_n").alias("_n"))
        before = step.select(f"_b{i}", *([f"_b{i + 1}"] if i < 2 else []), (F.sum("_n").over(inside) - F.col("_n")).alias(f"_before{i}"))
        steps = before if i == 0 else steps.join(before, f"_b{i}")
    total = F.col("_before0") + F.col("_before1") + F.col("_before2")
    return places.join(steps.select("_b0", total.alias("_before")), "_b0").select(key, (F.lit(start) + F.col("_before") + F.col("_place")).cast("long").alias("new_id"))


def promoted(facts: DataFrame, start: int) -> DataFrame:
    """facts: id, same_figure_as. Both in the target's ids; a link to a fact that isn't promoted is dropped and marked."""
    ids = reserved(facts, "id", start)
    own = facts.join(ids, "id").select("id", F.col("new_id").alias("target_id"), "same_figure_as")
    linked = own.join(ids.select(F.col("id").alias("same_figure_as"), F.col("new_id").alias("target_link")), "same_figure_as", "left")
    return linked.select("id", "target_id", "target_link", (F.col("same_figure_as").isNotNull() & F.col("target_link").isNull()).alias("dropped"))


def by_frequency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, values): each group's distinct stated values, most frequent first, ties by value."""
    counted = rows.where(F.trim(value) != "").groupBy(group, F.trim(value).alias("_v")).agg(F.count("*").alias("_n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))))
    return counted.groupBy(group).agg(F.transform(ordered, lambda x: x["v"]).alias(f"{value}_values"))
