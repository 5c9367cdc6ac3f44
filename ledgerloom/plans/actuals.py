"""Queries over reports of department actuals: read or refused whole, stored by their natural key, seen by department."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import actuals
from ledgerloom.sources.ledger import Ledger

#: Departments that a unit's report lists at most.
DEPARTMENTS = 40


def _code(part):
    k = part % DEPARTMENTS
    return F.concat(F.char(65 + F.floor(k / 26)), F.char(65 + k % 26))


def _reports(x: Ledger):
    """Two editions of a report of each supplier and year, whose departments are groups of parts; some are unreadable.

    After the total comes the second table, with other figures.
    """
    price, unit = F.col("l_extendedprice").cast("decimal(20,2)"), F.col("unit_id")
    lines = x.raw("lineitem").select(F.col("l_suppkey").alias("unit_id"), F.year("l_shipdate").alias("fiscal_year"), F.when(F.col("l_linenumber") <= 3, 1).otherwise(2).alias("edition"), _code(F.col("l_partkey")).alias("code"), price.alias("price"), "l_returnflag")
    sums = lines.groupBy("unit_id", "fiscal_year", "edition", "code").agg(F.sum("price").cast("decimal(24,2)").alias("all"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("price"))).cast("decimal(24,2)").alias("back"))
    back = F.coalesce(F.col("back").cast("string"), F.lit("--"))
    amount = F.concat(F.col("all").cast("string"), F.when(unit % 29 == 0, "00000001").otherwise(""))
    dash = F.when(unit % 2 == 0, " -").otherwise(" – ")
    cells = lambda first: F.concat(F.lit("<tr><td>"), F.col("code"), dash, F.lit("Works &amp; "), F.col("code"), F.lit("</td><td>"), first, F.lit("</td><td align=right>"), back, F.lit("</td><td>"), F.format_number("all", 2), F.lit("</td><td>0.000</td></tr>"))
    rows = sums.groupBy("unit_id", "fiscal_year", "edition").agg(F.sort_array(F.collect_list(F.struct("code", cells(amount).alias("first"), cells(F.lit("9.0")).alias("second")))).alias("rows"))
    joined = lambda field: F.array_join(F.col(f"rows.{field}"), "")
    months = F.when(unit % 3 == 0, "Yearly Budget july - September").when(unit % 3 == 1, "Yearly Budget April-March").otherwise("")
    said = F.when(unit % 17 == 0, "Amounts In Thousands").otherwise("(Amount&nbsp;in Crores)")
    head = F.concat(F.lit("<tr><th>"), F.when(unit % 13 == 0, "Dept").otherwise("Department"), F.lit("</th><th>"), F.when(unit % 19 == 0, "Budget").otherwise("budgeted"), F.lit("</th><th>Released</th><th>BEAMS Expenditure</th><th>Actual Expenditure in Treasury</th></tr>"))
    total = F.lit("<tr><td>Total</td><td>1</td><td>1</td><td>1</td><td>1</td></tr>")
    first = F.when(unit % 31 == 0, "").otherwise(F.concat(joined("first"), F.when(unit % 23 == 0, F.get("rows", F.lit(0))["first"]).otherwise("")))
    html = F.concat(F.lit("<table><tr><td>"), months, F.lit("</td></tr><tr><td>"), said, F.lit("</td></tr>"), head, first, total, head, joined("second"), total, F.lit("</table>"))
    report = (unit * 100000 + F.col("fiscal_year") * 10 + F.col("edition")).cast("long").alias("report_id")
    return rows.select(report, "unit_id", "fiscal_year", html.alias("html"))


def _stored(x: Ledger):
    return actuals.load(None, actuals.figures(actuals.parse(_reports(x))))


def department_actuals(spark, sf_dir):
    """What the store holds after every edition of every report that can be read."""
    return _stored(Ledger(spark, sf_dir))


def actuals_refusals(spark, sf_dir):
    """Reports that are refused, and why."""
    return actuals.refusals(actuals.parse(_reports(Ledger(spark, sf_dir))))


def department_by_code(spark, sf_dir):
    """Each department's years beside the sum of its settled schemes."""
    x = Ledger(spark, sf_dir)
    schemes = x.scheme_finance.where("utilized_inr IS NOT NULL").select(F.col("department_id").alias("unit_id"), _code(F.col("scheme_id")).alias("dept_code"), "fiscal_year", "allocated_inr")
    return actuals.by_department(_stored(x), schemes)


QUERIES = [department_actuals, actuals_refusals, department_by_code]

_LINES = f"""WITH l AS (SELECT l_suppkey AS unit_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS edition,
  chr(CAST(65 + (l_partkey % {DEPARTMENTS}) // 26 AS INTEGER)) || chr(CAST(65 + (l_partkey % {DEPARTMENTS}) % 26 AS INTEGER)) AS dept_code, CAST(l_extendedprice AS DECIMAL(20,2)) AS price, l_returnflag AS flag FROM lineitem),
r AS (SELECT unit_id, fiscal_year, edition, unit_id * 100000 + fiscal_year * 10 + edition AS report_id, dept_code, sum(price) AS everything, sum(price) FILTER (WHERE flag = 'R') AS back,
  CASE WHEN unit_id % 17 = 0 THEN 'unit_not_crores' WHEN unit_id % 13 = 0 THEN 'no_header' WHEN unit_id % 19 = 0 THEN 'missing_columns'
    WHEN unit_id % 31 = 0 THEN 'no_rows' WHEN unit_id % 29 = 0 THEN 'amount_not_exact' WHEN unit_id % 23 = 0 THEN 'department_twice' END AS refusal FROM l GROUP BY ALL),
s AS (SELECT unit_id, dept_code, fiscal_year, CAST(CASE WHEN unit_id % 3 = 0 THEN 7 ELSE 4 END AS INTEGER) AS from_month, CAST(CASE WHEN unit_id % 3 = 0 THEN 9 ELSE 3 END AS INTEGER) AS to_month, report_id, 'Works & ' || dept_code AS name_en,
  CAST(everything * 10000000 AS DECIMAL(20,2)) AS budgeted_inr, CAST(back * 10000000 AS DECIMAL(20,2)) AS released_inr, CAST(NULL AS DECIMAL(20,2)) AS received_inr, CAST(everything * 10000000 AS DECIMAL(20,2)) AS spent_inr, CAST(0 AS DECIMAL(20,2)) AS treasury_inr
  FROM r WHERE refusal IS NULL QUALIFY row_number() OVER (PARTITION BY unit_id, dept_code, fiscal_year ORDER BY edition DESC) = 1)"""

SQL = {
    "department_actuals": f"{_LINES} SELECT * FROM s",
    "actuals_refusals": f"{_LINES} SELECT DISTINCT report_id, refusal FROM r WHERE refusal IS NOT NULL",
    "department_by_code": f"""{_LINES}, a AS (SELECT unit_id, dept_code, fiscal_year, CAST(sum(price) AS DECIMAL(30,2)) AS allocated_alternate_inr FROM l WHERE flag != 'N' GROUP BY ALL)
SELECT s.unit_id, s.dept_code, s.fiscal_year, from_month, to_month, name_en, budgeted_inr AS allocated_inr, allocated_alternate_inr, released_inr, spent_inr AS utilized_inr, treasury_inr,
  CAST(released_inr - spent_inr AS DECIMAL(21,2)) AS release_variance_inr, CAST(budgeted_inr - spent_inr AS DECIMAL(21,2)) AS allocation_variance_inr,
  CASE WHEN released_inr IS NULL THEN 'insufficient_data' ELSE 'complete' END AS status
FROM s LEFT JOIN a ON a.unit_id = s.unit_id AND a.dept_code = s.dept_code AND a.fiscal_year = s.fiscal_year""",
}
