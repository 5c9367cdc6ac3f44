"""Reads of open tenders: counts by district, departments, listings, unplaced counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.sources.ledger import INFERRED

#: Most rows of a listing.
MOST_LISTED = 200


def still_open(as_of: Column, closing: str = "closing_at") -> Column:
    """Open: no closing time is known, or it is still to come."""
    return F.col(closing).isNull() | (F.col(closing) > as_of)


def narrowed(tenders: DataFrame, as_of: Column, department: str | None = None, unit_id: int | None = None, unplaced_only: bool = False, portals: DataFrame | None = None) -> DataFrame:
    """Open tenders; a filter is added only for a parameter that is set."""
    out = tenders.where(still_open(as_of))
    if department is not None:
        out = out.where(F.col("department") == department)
    if unit_id is not None:
        out = out.where(F.col("admin_unit_id") == unit_id)
    if unplaced_only:
        out = out.where("admin_unit_id IS NULL")
    if portals is not None:
        out = out.join(portals.select("portal_code"), "portal_code", "left_semi")
    return out


def counts_by_district(tenders: DataFrame, units: DataFrame, as_of: Column, department: str | None = None, subtree: DataFrame | None = None) -> DataFrame:
    """Open tenders of each district, how many were placed by inference, and the departments, sorted.

    Counts and names are aggregated by unit before the join, so what the join moves is one row a unit.
    """
    rows = narrowed(tenders, as_of, department).where("admin_unit_id IS NOT NULL")
    if subtree is not None:
        rows = rows.join(subtree.select(F.col("id").alias("admin_unit_id")), "admin_unit_id", "left_semi")
    counted = rows.groupBy("admin_unit_id").agg(
        F.count("*").alias("tender_count"),
        F.count_if(F.col("district_source").isin(*INFERRED)).alias("inferred_count"),
        F.array_sort(F.collect_set("department")).alias("departments"),
    )
    return counted.join(units.select(F.col("id").alias("admin_unit_id"), F.col("name_en").alias("district_name")), "admin_unit_id")


def departments(tenders: DataFrame, as_of: Column, portals: DataFrame | None = None) -> DataFrame:
    """Departments that advertise now, with their open tenders."""
    return narrowed(tenders, as_of, portals=portals).where("department IS NOT NULL").groupBy("department").agg(F.count("*").alias("tender_count"))


def listing(tenders: DataFrame, units: DataFrame, as_of: Column, limit: int = 100, **narrow) -> DataFrame:
    """The next to close first, unknown closing last; limited before the join, which then meets a few rows only."""
    first = narrowed(tenders, as_of, **narrow).orderBy(F.asc_nulls_last("closing_at"), "title", "id").limit(min(limit, MOST_LISTED))
    named = first.join(units.select(F.col("id").alias("admin_unit_id"), F.col("name_en").alias("district_name")), "admin_unit_id", "left")
    return named.select("id", "title", "department", "closing_at", "district_name", "district_source", money.to_rupees(F.col("tender_value_paise")).cast("string").alias("tender_value_inr"))


def unplaced(tenders: DataFrame, as_of: Column, portals: DataFrame | None = None) -> DataFrame:
    return narrowed(tenders, as_of, unplaced_only=True, portals=portals).agg(F.count("*").alias("unplaced"))


def open_by_state_district(tenders: DataFrame, units: DataFrame, as_of: Column) -> DataFrame:
    """Open tenders by the codes of state and district."""
    counted = narrowed(tenders, as_of).where("admin_unit_id IS NOT NULL").groupBy("admin_unit_id").agg(F.count("*").alias("open_tenders"))
    d = units.where("level = 'district'").select(F.col("id").alias("admin_unit_id"), F.col("lgd_code").alias("district_lgd_code"), F.col("parent_id").alias("_state"))
    s = units.where("level = 'state'").select(F.col("id").alias("_state"), F.col("lgd_code").alias("state_lgd_code"))
    return counted.join(d, "admin_unit_id").join(s, "_state").select("state_lgd_code", "district_lgd_code", "open_tenders").orderBy(F.length("state_lgd_code"), "state_lgd_code", F.length("district_lgd_code"), "district_lgd_code")
