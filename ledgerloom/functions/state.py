"""Policy and state algebra: licences, publication, collection states, holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def licence_id(source_id: Column, recorded: list[str]) -> Column:
    """The licence that governs a source: its own, else that of the part before its first hyphen."""
    family = F.when(F.instr(source_id, "-") > 1, F.substring_index(source_id, "-", 1)).otherwise(source_id)
    return F.when(source_id.isin(*recorded), source_id).otherwise(family)


def publication_decision(rows: DataFrame, source: str, licences: DataFrame, grants: DataFrame, switched_on: list[str], issuer: Column | None = None) -> DataFrame:
    """Rows with publishable and basis or reason: terms, then a recorded grant, then an operator's switch.

    licences (source_id, republication) and grants (source_id, issuer) are the publisher registry, some
    dozens of rows by nature; they are joined by broadcast after a check of their number.
    """
    recorded = [r[0] for r in licences.select("source_id").limit(10_001).collect()]
    if len(recorded) > 10_000:
        raise ValueError("the licence registry is larger than a registry of publishers can be")
    whole = grants.where("issuer IS NULL").select("source_id").distinct().withColumn("_whole", F.lit(True))
    keyed = rows.withColumn("_licence", licence_id(F.col(source), recorded)).withColumn("_issuer", issuer if issuer is not None else F.lit(None).cast("string"))
    j = keyed.join(F.broadcast(licences.withColumnRenamed("source_id", "_licence")), "_licence", "left").join(F.broadcast(whole.withColumnRenamed("source_id", "_licence")), "_licence", "left")
    per_issuer = grants.where("issuer IS NOT NULL").select(F.col("source_id").alias("_licence"), F.col("issuer").alias("_issuer")).distinct().withColumn("_one", F.lit(True))
    j = j.join(F.broadcast(per_issuer), ["_licence", "_issuer"], "left")
    granted = F.coalesce("_whole", "_one", F.lit(False))
    outcome = (
        F.when(F.col("republication").isNull() | (F.col("republication") == "unknown"), "terms_unrecorded")
        .when(F.col("republication") == "permitted", "terms_permit")
        .when(~granted, "permission_not_granted")
        .when(~F.col("_licence").isin(*switched_on) if switched_on else F.lit(True), "not_switched_on")
        .otherwise("grant_recorded")
    )
    return j.withColumn("decision", outcome).withColumn("publishable", F.col("decision").isin("terms_permit", "grant_recorded")).drop("_licence", "_issuer", "_whole", "_one", "republication")


def data_state(collection: Column, freshness: Column, completeness: Column) -> Column:
    return F.struct(collection.alias("collection"), freshness.alias("freshness"), completeness.alias("completeness"))


def tender_collection_state(status: Column) -> Column:
    none = status.isNull() | (status == "not_collected")
    return data_state(F.when(none, "not_collected").otherwise("collected"), F.when(none, "unknown").when(status == "collected", "fresh").otherwise(status), F.lit("unknown"))


def level_coverage_state(status: Column) -> Column:
    none = status == "not_collected"
    return data_state(F.when(none, "not_collected").otherwise("collected"), F.lit("unknown"), F.when(none, "unknown").otherwise(status))


def display_state(state: Column, transport: Column | None = None) -> Column:
    """The headline that wins: transport, unknown, not collected, failing or stale, partial, current, held."""
    transport = F.lit("ok") if transport is None else transport
    return (
        F.when(transport != "ok", transport)
        .when(state.isNull() | (state["collection"] == "unknown"), "unknown")
        .when(state["collection"] == "not_collected", "not_collected")
        .when(state["freshness"].isin("failing", "stale"), state["freshness"])
        .when(state["completeness"] == "partial", "partial")
        .when(state["freshness"] == "fresh", "current")
        .otherwise("held")
    )


def may_show_counts(state: Column) -> Column:
    return F.coalesce(state["collection"] == "collected", F.lit(False))


def known(value: Column, detail_read: Column) -> Column:
    """struct(state, value, why): a field's value, or why it is missing."""
    missing = value.isNull() | (value.cast("string") == "")
    return F.struct(F.when(missing, "missing").otherwise("known").alias("state"), F.when(~missing, value).alias("value"), F.when(missing, F.when(detail_read, "not_stated").otherwise("detail_not_read")).alias("why"))


def sweep_exit_code(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """69 if every portal refused, else 0."""
    return outcomes.agg(F.when(F.coalesce(F.bool_and(F.col(column) == "refused"), F.lit(False)), 69).otherwise(0).alias("code"))


def registry(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(entries, "source_id string, republication string")
