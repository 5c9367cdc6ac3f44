"""Scheme-budget exports: pages that are one loose table, whose year, unit and columns must be stated to be read.

An export is read whole or refused whole: without its year, its unit or a needed column, any figure would be a guess.
A refused export gives no rows and is listed with its reason; amounts are exact, and a cell without a figure is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import markup, money

# Columns as exports spell them. A row needs those of REQUIRED; AMOUNTS are in thousands of rupees.
REQUIRED = ("DEPT", "DEMAND_NO", "SCHEME_CODE", "OBJECT_CODE", "BUDGET", "EXPENDITURE")
COORDINATES = {"dept_code": "DEPT", "demand_no": "DEMAND_NO", "scheme_code": "SCHEME_CODE", "object_code": "OBJECT_CODE"}
TEXTS = {"name_en": "BUDBOOK_SCHEMENM_ENGLISH", "name_short": "SCHEME_NM", "name_local": "BUDBOOK_SCHEMENM_MARATHI", "charged_voted": "CHARGED_VOTED", "scheme_committed": "SCHEME_COMITTED", "source_of_fund": "Source of fund", "plan_type": "Plan Type"}
AMOUNTS = {"allocated_inr": "BUDGET", "released_fd_inr": "RELEASED FD", "released_inr": "RELEASED Dept", "utilized_inr": "EXPENDITURE", "reappropriated_inr": "REAPP"}


def column_name(name: Column) -> Column:
    """A header cell without its dots and spaces, in lower case: spelling drifts between years."""
    return F.lower(F.regexp_replace(name, r"(?U)[.\s]+", ""))


def _line(rows: Column, words: str) -> Column:
    """The first row of which a cell holds the words, in any case, as one text."""
    return F.array_join(F.get(F.filter(rows, lambda r: F.exists(r, lambda c: c.rlike(f"(?i){words}"))), F.lit(0)), " ")


def _stated(cell: Column) -> Column:
    return F.when(~F.trim(cell).isin(*money.ABSENT), F.trim(cell))


def parse(exports: DataFrame) -> DataFrame:
    """exports: export_id, html. Adds rows (cells), fiscal_year, at (the header's row, from 0), header (normalised) and refusal."""
    read = markup.bound(exports, ["export_id"], rows=markup.rows_by_split(F.col("html")))
    stated = markup.bound(
        read, ["export_id", "rows"], fiscal_year=F.regexp_extract(_line(F.col("rows"), "financial year"), "([0-9]{4})", 1).try_cast("int"), unit=_line(F.col("rows"), "amounts in"),
        at=(F.array_position(F.transform("rows", lambda r: F.array_contains(r, "DEPT")), F.lit(True)) - 1).cast("int"),
    )
    headed = markup.bound(stated, stated.columns, header=F.transform(F.get("rows", F.when(F.col("at") >= 0, F.col("at"))), column_name))
    needed = F.array(*[column_name(F.lit(c)) for c in REQUIRED])
    refusal = (
        F.when(F.col("fiscal_year").isNull(), "year_not_stated")
        .when(~F.coalesce(F.col("unit").rlike("(?i)amounts in thousands"), F.lit(False)), "unit_not_thousands")
        .when(F.col("header").isNull(), "no_header")
        .when(F.size(F.array_except(needed, F.col("header"))) > 0, "missing_columns")
    )
    return markup.bound(headed, ["export_id", "rows", "fiscal_year", "at", "header"], refusal=refusal)


def figures(parsed: DataFrame) -> DataFrame:
    """A row for each scheme and object of the exports that aren't refused, with its place in the export.

    Older exports leave trailing cells out: a row needs cells up to the last required column. Rows without all four
    coordinates (subtotals, spacers) are no figures.
    """
    sound = parsed.where("refusal IS NULL")
    place = lambda name: F.array_position("header", column_name(F.lit(name))).cast("int")
    columns = COORDINATES | TEXTS | AMOUNTS
    sound = markup.bound(sound, ["export_id", "fiscal_year", "rows", "at"], last=F.greatest(*[place(c) for c in REQUIRED]), places=F.struct(*[F.nullif(place(c), F.lit(0)).alias(n) for n, c in columns.items()]))
    each = sound.select("export_id", "fiscal_year", "places", "last", F.posexplode(F.expr("slice(rows, at + 2, size(rows))")).alias("place", "cells")).where("size(cells) >= last")
    cell = lambda name: F.get("cells", F.col(f"places.{name}") - 1)
    rows = markup.bound(each, ["export_id", "fiscal_year", "place", "places", "cells"], **{n: _stated(cell(n)) for n in COORDINATES | TEXTS})
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in COORDINATES))
    rows = rows.select("export_id", "fiscal_year", "place", *COORDINATES, *TEXTS, *[money.to_rupees(money.published_to_paise(cell(n), "thousands")["paise"]).alias(n) for n in AMOUNTS])
    return rows.withColumn("name_en", F.coalesce("name_en", "name_short")).drop("name_short")


def finance(figures: DataFrame) -> DataFrame:
    """One row a department, demand, scheme, object and year: the last one that the exports state."""
    key = ["dept_code", "demand_no", "scheme_code", "object_code", "fiscal_year"]
    rest = [c for c in figures.columns if c not in key]
    return figures.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("export_id", "place")).alias("last")).select(*key, "last.*")


def refusals(parsed: DataFrame, figures: DataFrame) -> DataFrame:
    """(export_id, refusal) of every export that gives no figures."""
    held = figures.select("export_id").distinct()
    empty = parsed.where("refusal IS NULL").join(held, "export_id", "left_anti").select("export_id", F.lit("no_rows").alias("refusal"))
    return parsed.where("refusal IS NOT NULL").select("export_id", "refusal").unionByName(empty)
