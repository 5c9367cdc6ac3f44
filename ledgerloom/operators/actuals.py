"""Reports of department actuals: pages that print their table twice, in crores, for a range of months.

Only the first table counts: rows up to the first "Total". A report is read whole or refused whole; a cell without a figure
is null and never zero. Everything about one report is a Column over its own row, so that reading moves nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import markup, money

# Header cells by pattern, what a report must hold, and the names of months.
COLUMNS = {"budgeted_inr": "(?i)^Budgeted$", "released_inr": "(?i)^Released$", "received_inr": "(?i)^Received$", "spent_inr": "(?i)BEAMS Expenditure", "treasury_inr": "(?i)Actual Expenditure in Trea"}
NEEDED = ("budgeted_inr", "released_inr", "spent_inr")
DEPARTMENT = r"(?U)^([A-Z]{1,3})\s*[-–—]\s*(.+)$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The financial year runs from April to March where a report names no months.
YEAR_FROM, YEAR_TO = 4, 3
KEY = ("unit_id", "dept_code", "fiscal_year", "from_month", "to_month")


def _first_place(items: Column, test) -> Column:
    """The place (from 1) of the first item that passes, else 0."""
    return F.array_position(F.transform(items, lambda i: F.coalesce(test(i), F.lit(False))), F.lit(True)).cast("int")


def _month(name: Column, otherwise: int) -> Column:
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")
    return F.when(place > 0, place).otherwise(otherwise)


def parse(reports: DataFrame) -> DataFrame:
    """reports: report_id, unit_id, fiscal_year, html. Gives (report_id, unit_id, fiscal_year, from_month, to_month, departments, refusal).

    Refusals, the first that holds: unit_not_crores, no_header, missing_columns, amount_not_exact, no_rows, department_twice.
    A null page states no unit. Rows whose first cell is no "CODE - name" are no departments.
    """
    key = ["report_id", "unit_id", "fiscal_year"]
    read = markup.bound(reports, key, rows=F.coalesce(markup.rows_by_split(F.col("html")), F.expr("cast(array() AS array<array<string>>)")))
    read = markup.bound(
        read, [*key, "rows"], flat=F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " "),
        head=_first_place(F.col("rows"), lambda r: F.exists(r, lambda c: c.rlike("(?i)^Department$"))),
        total=_first_place(F.col("rows"), lambda r: F.get(r, F.lit(0)).rlike("(?i)^Total$")),
    )
    months = lambda group: F.regexp_extract("flat", r"Yearly Budget\s+([A-Za-z]+)\s*-\s*([A-Za-z]+)", group)
    header = F.get("rows", F.when(F.col("head") > 0, F.col("head") - 1))
    places = F.struct(*[F.coalesce(_first_place(header, lambda c, p=p: c.rlike(p)), F.lit(0)).alias(n) for n, p in COLUMNS.items()])
    placed = markup.bound(
        read, key, head=F.col("head"), crores=F.col("flat").rlike(r"(?i)Amount\s+in\s+Crores"), from_month=_month(months(1), YEAR_FROM), to_month=_month(months(2), YEAR_TO),
        places=places, scope=F.when(F.col("total") > 0, F.slice("rows", F.lit(1), F.col("total") - 1)).otherwise(F.col("rows")),
    )

    def department(row: Column) -> Column:
        figure = lambda n: money.published_to_paise(F.get(row, F.nullif(F.col(f"places.{n}"), F.lit(0)) - 1), "crores")
        name = lambda group: F.regexp_extract(F.get(row, F.lit(0)), DEPARTMENT, group)
        return F.struct(name(1).alias("dept_code"), F.trim(name(2)).alias("name_en"), *[figure(n).alias(n) for n in COLUMNS])

    stated = F.filter("scope", lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(DEPARTMENT), F.lit(False)))
    held = markup.bound(placed, [*key, "head", "crores", "places", "from_month", "to_month"], departments=F.transform(stated, department))
    codes = F.transform("departments", lambda d: d["dept_code"])
    odd = F.exists("departments", lambda d: reduce(lambda a, b: a | b, [d[n]["refusal"].isNotNull() for n in COLUMNS]))
    refusal = (
        F.when(~F.col("crores"), "unit_not_crores")
        .when(F.col("head") == 0, "no_header")
        .when(F.least(*[F.col(f"places.{n}") for n in NEEDED]) == 0, "missing_columns")
        .when(odd, "amount_not_exact")
        .when(F.size("departments") == 0, "no_rows")
        .when(F.size(F.array_distinct(codes)) < F.size("departments"), "department_twice")
    )
    return markup.bound(held, [*key, "from_month", "to_month", "departments"], refusal=refusal)


def figures(parsed: DataFrame) -> DataFrame:
    """A row a department of each report that isn't refused, amounts in rupees."""
    each = parsed.where("refusal IS NULL").select("report_id", "unit_id", "fiscal_year", "from_month", "to_month", F.explode("departments").alias("d"))
    return each.select("report_id", *[f"d.{c}" if c == "dept_code" else c for c in KEY], "d.name_en", *[money.to_rupees(F.col(f"d.{n}.paise")).alias(n) for n in COLUMNS])


def refusals(parsed: DataFrame) -> DataFrame:
    return parsed.where("refusal IS NOT NULL").select("report_id", "refusal")


def load(held: DataFrame | None, arriving: DataFrame) -> DataFrame:
    """What a store holds after the arriving figures: one row a unit, department, year and range of months, the later report's.

    A later report replaces the whole row, so a figure that it no longer states becomes null. Replaying a report changes nothing.
    """
    rows = arriving if held is None else held.unionByName(arriving)
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "report_id").alias("last")).select(*KEY, "last.*")


def by_department(stored: DataFrame, schemes: DataFrame, unit_id: int | None = None, code: str | None = None) -> DataFrame:
    """A department's years beside the sum of its schemes, with the name that its latest report states; all departments unless one is asked for.

    schemes: unit_id, dept_code, fiscal_year, allocated_inr. The sum is null where no scheme states an allocation. Variances
    are exact and null with a missing part. Orders nothing: readers sort a department's years from the newest.
    """
    wanted = F.lit(True) if unit_id is None else F.col("unit_id") == unit_id
    wanted = wanted if code is None else wanted & (F.col("dept_code") == code)
    stored, schemes = stored.where(wanted), schemes.where(wanted)
    sums = schemes.groupBy("unit_id", "dept_code", "fiscal_year").agg(F.sum("allocated_inr").cast("decimal(30,2)").alias("allocated_alternate_inr"))
    names = stored.groupBy("unit_id", "dept_code").agg(F.max_by("name_en", "report_id").alias("name_en"))
    years = stored.drop("name_en", "report_id").join(sums, ["unit_id", "dept_code", "fiscal_year"], "left").join(names, ["unit_id", "dept_code"])
    missing = F.col("budgeted_inr").isNull() | F.col("released_inr").isNull() | F.col("spent_inr").isNull()
    return years.select(
        *KEY, "name_en", F.col("budgeted_inr").alias("allocated_inr"), "allocated_alternate_inr", "released_inr", F.col("spent_inr").alias("utilized_inr"), "treasury_inr",
        money.minus(F.col("released_inr"), F.col("spent_inr")).alias("release_variance_inr"), money.minus(F.col("budgeted_inr"), F.col("spent_inr")).alias("allocation_variance_inr"),
        F.when(missing, "insufficient_data").otherwise("complete").alias("status"),
    )
