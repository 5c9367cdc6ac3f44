"""One tender as a record: every field is known, with how to read it, or missing, with the reason.

A record is an array of struct(section, field, kind, value, why), 27 fields in the order that a reader meets them,
made by built-in functions alone: no row moves. ``why`` is null for a known field, ``kind`` and ``value`` for a
missing one. Input columns: title, tender_category, product_category, tender_type, location, pincode,
district_name, district_source, department, organisation_chain, value_inr, emd_inr, closing_at, bid_opening_at
(text or null each) and detail_fields, the page's labels and values, null if the page was never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import markup, money, text

# The labels that portals print each field under, in order of preference.
LABELS = {
    "workDescription": ("Work Description", "Work Item Description"),
    "contractForm": ("Form Of Contract", "Form of Contract", "Contract Type"),
    "tenderFee": ("Tender Fee in ₹", "Tender Fee in Rs", "Tender Fee"),
    "published": ("Published Date", "Publish Date"),
    "documentsFrom": ("Document Download / Sale Start Date", "Document Download Start Date"),
    "documentsUntil": ("Document Download / Sale End Date", "Document Download End Date"),
    "preBidDate": ("Pre Bid Meeting Date",),
    "preBidPlace": ("Pre Bid Meeting Place", "Pre Bid Meeting Address"),
    "periodOfWork": ("Period Of Work(Days)", "Period Of Work (Days)", "Period of Work(Days)"),
}
# Why a field is missing.
NOT_ON_PAGE, NOT_READ, NO_AWARD = "not_on_page", "detail_not_read", "award_not_collected"
NO_SITE, NO_PROGRESS, NO_DISTRICT = "site_not_stated", "progress_not_available", "district_not_established"


def printed(fields: Column, name: str) -> Column:
    """The first of a field's labels that states something, trimmed; null if none does or the page was never read."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(fields, F.lit(label))), F.lit("")) for label in LABELS[name]])


def printed_together(fields: Column, names: tuple[str, ...], separator: str) -> Column:
    """What several fields print, joined; null if none of them prints anything."""
    return F.nullif(F.concat_ws(separator, *[printed(fields, n) for n in names]), F.lit(""))


def record(detail: Column) -> Column:
    """The fields of a tender whose columns stand beside ``detail``, its page's labels and values."""
    return F.concat(*_sections(detail).values())


def with_fields(tenders: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns, each section's fields (``what_fields`` ..) and all as ``fields``; a tender's page is made once and not once a label.

    Each section is a step of its own: the code of all 27 fields in one is too long for the JVM to compile.
    """
    rows = markup.bound(tenders, [c for c in tenders.columns if c != "detail_fields"], detail_fields=F.col("detail_fields"))
    made = {f"{name}_fields": fields for name, fields in _sections(F.col("detail_fields")).items()}
    for name, fields in made.items():
        rows = markup.bound(rows, rows.columns, **{name: fields})
    return markup.bound(rows, [*kept, *made], fields=F.concat(*made))


def _sections(detail: Column) -> dict[str, Column]:
    unread = F.when(detail.isNull(), NOT_READ).otherwise(NOT_ON_PAGE)
    district = F.when(F.col("district_source").isNotNull(), F.col("district_name"))
    offices = F.nullif(F.array_join(text.chain_segments(F.coalesce("organisation_chain", F.lit(""))), "||"), F.lit(""))
    nothing = F.lit(None).cast("string")
    sections = {
        "what": [
            ("title", "text", F.col("title"), unread),
            ("workDescription", "text", printed(detail, "workDescription"), unread),
            ("tenderCategory", "text", F.col("tender_category"), unread),
            ("workCategory", "text", F.col("product_category"), unread),
            ("tenderType", "text", F.col("tender_type"), unread),
            ("contractForm", "text", printed(detail, "contractForm"), unread),
        ],
        "where": [
            ("officeDistrict", "office_district", district, F.lit(NO_DISTRICT)),
            ("statedLocation", "text", F.col("location"), unread),
            ("pincode", "text", F.col("pincode"), unread),
            ("workSite", "text", nothing, F.lit(NO_SITE)),
        ],
        "who": [
            ("department", "text", F.col("department"), unread),
            ("issuingOffice", "chain", offices, unread),
            ("bidders", "text", nothing, F.lit(NO_AWARD)),
            ("winner", "text", nothing, F.lit(NO_AWARD)),
        ],
        "money": [
            ("estimatedValue", "rupees", F.col("value_inr"), unread),
            ("bidSecurity", "rupees", F.col("emd_inr"), unread),
            ("tenderFee", "as_printed", money.fee_as_printed(printed(detail, "tenderFee")), unread),
            ("winningBid", "rupees", nothing, F.lit(NO_AWARD)),
            ("contractValue", "rupees", nothing, F.lit(NO_AWARD)),
            ("amountPaid", "rupees", nothing, F.lit(NO_PROGRESS)),
        ],
        "when": [
            ("published", "as_printed", printed(detail, "published"), unread),
            ("documentsAvailable", "as_printed", printed_together(detail, ("documentsFrom", "documentsUntil"), " to "), unread),
            ("preBidMeeting", "as_printed", printed_together(detail, ("preBidDate", "preBidPlace"), ", "), unread),
            ("bidsClose", "date", F.col("closing_at"), unread),
            ("bidsOpen", "date", F.col("bid_opening_at"), unread),
            ("periodOfWork", "as_printed", printed(detail, "periodOfWork"), unread),
            ("workProgress", "text", nothing, F.lit(NO_PROGRESS)),
        ],
    }
    return {section: F.array(*[_field(section, *field) for field in fields]) for section, fields in sections.items()}


def _field(section: str, name: str, kind: str, value: Column, why: Column) -> Column:
    missing = value.isNull()
    return F.struct(F.lit(section).alias("section"), F.lit(name).alias("field"), F.when(~missing, kind).alias("kind"), value.alias("value"), F.when(missing, why).alias("why"))


def missing_by_reason(fields: Column) -> Column:
    """array<struct(why, fields)>: each reason once, in the order of its first field, with its fields in order."""

    def grouped(absent: Column) -> Column:
        """absent: a bound name, so that the missing fields are picked once and not once a reason."""
        named = lambda why: F.filter(absent, lambda f: f["why"] == why)["field"]
        return F.transform(F.array_distinct(absent["why"]), lambda why: F.struct(why.alias("why"), named(why).alias("fields")))

    return F.element_at(F.transform(F.array(F.filter(fields, lambda f: f["why"].isNotNull())), grouped), 1)


def status(closing_at: Column, as_of: Column) -> Column:
    """open, closed or unknown, from the closing time alone; a passed deadline is no award."""
    return F.when(closing_at.isNull(), "unknown").when(closing_at > as_of, "open").otherwise("closed")


def with_changes(tenders: DataFrame, readings: DataFrame) -> DataFrame:
    """Adds changes: how many earlier readings of a tender are kept. readings: tender_id, one row a reading."""
    kept = readings.groupBy(F.col("tender_id").alias("id")).agg((F.count("*") - 1).alias("changes"))
    return tenders.join(kept, "id", "left").withColumn("changes", F.coalesce("changes", F.lit(0)).cast("long"))
