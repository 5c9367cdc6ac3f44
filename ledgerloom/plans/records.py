"""Queries over whole tender records and over scheme-budget exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import tender_record
from ledgerloom.operators import budget
from ledgerloom.sources.ledger import AS_OF, Ledger, as_of

SECTIONS = ("what", "where", "who", "money", "when")


def tender_records(spark, sf_dir):
    """Every tender's record, a text a section, and its missing fields by reason; a quarter of the pages was never read."""
    x = Ledger(spark, sf_dir)
    home = x.raw("customer").join(F.broadcast(x.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    o = x.raw("orders").join(home, F.col("o_custkey") == F.col("c_custkey"))
    key, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    page = {
        "Work Description": F.when(key % 3 == 0, "  ").otherwise(F.concat(F.lit(" Works of "), "o_orderpriority")),
        "Work Item Description": F.concat(F.lit("Items of "), "o_orderstatus"),
        "Form of Contract": F.when(customer % 2 == 0, "Percentage"),
        "Tender Fee in Rs": F.when(key % 5 == 0, "Exempted").otherwise((key % 1000).cast("string")),
        "Publish Date": day,
        "Document Download Start Date": day,
        "Document Download / Sale End Date": F.when(customer % 3 == 1, "until sold"),
        "Pre Bid Meeting Place": F.when(customer % 5 == 2, "Hall 2"),
        "Period Of Work (Days)": (customer % 400).cast("string"),
    }
    detail = F.when(key % 4 != 0, F.create_map(*[c for label, value in page.items() for c in (F.lit(label), value)]))
    tenders = o.select(
        key.alias("id"), F.concat(F.lit("Tender "), key.cast("string")).alias("title"), F.col("o_orderstatus").alias("tender_category"),
        F.when(customer % 4 != 0, F.col("o_orderpriority")).alias("product_category"), F.when(key % 2 == 1, "Open Tender").alias("tender_type"), F.lit(None).cast("string").alias("location"),
        F.when(customer % 3 != 0, (customer % 1000 + 400000).cast("string")).alias("pincode"), F.col("n_name").alias("district_name"), F.when(customer % 7 != 0, "chain_unit").alias("district_source"),
        F.col("o_orderpriority").alias("department"), F.when(customer % 6 != 0, F.concat(F.lit("State || ||"), "c_name", F.lit(" ||"))).alias("organisation_chain"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("value_inr"), F.lit(None).cast("string").alias("emd_inr"),
        F.when(key % 11 != 0, day).alias("closing_at"), F.lit(None).cast("string").alias("bid_opening_at"), detail.alias("detail_fields"),
    )
    # changes are joined while rows are narrow
    tenders = tender_record.with_changes(tenders, x.raw("lineitem").select(F.col("l_orderkey").alias("tender_id")))
    rows = tender_record.with_fields(tenders.withColumn("status", tender_record.status(F.to_timestamp("closing_at"), as_of())), ["id", "status", "changes"])
    # concat works its type out anew for every value inside a lambda, concat_ws doesn't
    said = lambda f: F.when(f["value"].isNull(), F.concat_ws("!", f["field"], f["why"])).otherwise(F.concat_ws(":", F.concat_ws("=", f["field"], f["kind"]), f["value"]))
    section = lambda s: F.array_join(F.transform(f"{s}_fields", said), ";").alias(f"{s}_section")
    missing = F.transform(tender_record.missing_by_reason(F.col("fields")), lambda r: F.concat_ws(":", r["why"], F.array_join(r["fields"], ",")))
    return rows.select("id", "status", "changes", *[section(s) for s in SECTIONS], F.array_join(missing, ";").alias("missing"))


def _exports(x: Ledger):
    """An export of each customer's orders as scheme rows; some state no year, another unit, no header or too few columns."""
    customer, price = F.col("o_custkey"), F.col("o_totalprice").cast("decimal(20,2)")
    short = customer % 3 == 0
    cell = lambda c: F.concat(F.lit("<td class=x>"), c)
    spent = F.when(F.col("o_orderstatus") == "O", "-").otherwise(price.cast("string"))
    coordinates = [F.concat(F.lit("D"), (customer % 50).cast("string")), F.lit("7"), F.substring("o_orderpriority", 1, 1), F.when(customer % 29 == 0, "--").otherwise(F.concat(F.lit("O"), (F.col("o_orderkey") % 100).cast("string")))]
    name = F.when(F.col("o_orderkey") % 7 == 0, "null").otherwise(F.concat(F.lit("Scheme  "), "o_orderpriority"))
    moved = F.when(F.col("o_orderkey") % 5 == 0, "-5.25").otherwise("")
    full = [*coordinates, F.format_number(price, 2), F.format_number(price, 2), spent, name, moved]
    row = F.concat(F.lit("<tr>"), F.when(short, F.concat(*map(cell, [*coordinates, price.cast("string"), spent]))).otherwise(F.concat(*map(cell, full))))
    rows = x.raw("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    year = F.when(customer % 23 == 0, "all years").otherwise(F.concat((customer % 9 + 2010).cast("string"), F.lit("-x")))
    unit = F.when(customer % 17 == 0, "Amounts In Crores").otherwise("(Amounts&nbsp;In Thousands)")
    first, amount = F.when(customer % 13 == 0, "DEPARTMENT").otherwise("DEPT"), F.when(customer % 19 == 0, "BUDGT").otherwise(" BUDGET ")
    names = F.when(short, F.concat(amount, F.lit("<th>EXPENDITURE.<th>Released Dept<th>SCHEME NM"))).otherwise(F.concat(amount, F.lit("<th>RELEASED Dept.<th>EXPENDITURE<th>SCHEME_NM<th> REAPP")))
    head = F.concat(F.lit("<table><tr><td colspan=9>Financial Year : "), year, F.lit("</td><tr><td>"), unit, F.lit("<tr><th>"), first, F.lit("<th>DEMAND_NO<th>SCHEME_CODE<th>OBJECT_CODE<th>"), names)
    return rows.select(customer.alias("export_id"), F.concat(head, "rows", F.lit("<tr><td>Total<td><td><td>-<td>9<td>9<td>9</table>")).alias("html"))


def budget_finance(spark, sf_dir):
    """Scheme finance of all exports that state year, unit and columns, the last statement of each key."""
    last = budget.finance(budget.figures(budget.parse(_exports(Ledger(spark, sf_dir)))))
    return last.select("dept_code", "demand_no", "scheme_code", "object_code", "fiscal_year", "export_id", "name_en", "allocated_inr", "released_inr", "utilized_inr", "reappropriated_inr")


def budget_refusals(spark, sf_dir):
    """Exports that give no figures, and why."""
    parsed = budget.parse(_exports(Ledger(spark, sf_dir)))
    return budget.refusals(parsed, budget.figures(parsed))


QUERIES = [tender_records, budget_finance, budget_refusals]


def _fields() -> str:
    """The list of the 27 fields' structs in SQL."""
    unread = "CASE WHEN o_orderkey % 4 = 0 THEN 'detail_not_read' ELSE 'not_on_page' END"
    on_page = lambda value: f"CASE WHEN o_orderkey % 4 != 0 THEN {value} END"
    fields = [
        ("what", "title", "text", "'Tender ' || o_orderkey", unread),
        ("what", "workDescription", "text", on_page("CASE WHEN o_orderkey % 3 = 0 THEN 'Items of ' || o_orderstatus ELSE 'Works of ' || o_orderpriority END"), unread),
        ("what", "tenderCategory", "text", "o_orderstatus", unread),
        ("what", "workCategory", "text", "CASE WHEN o_custkey % 4 != 0 THEN o_orderpriority END", unread),
        ("what", "tenderType", "text", "CASE WHEN o_orderkey % 2 = 1 THEN 'Open Tender' END", unread),
        ("what", "contractForm", "text", on_page("CASE WHEN o_custkey % 2 = 0 THEN 'Percentage' END"), unread),
        ("where", "officeDistrict", "office_district", "CASE WHEN o_custkey % 7 != 0 THEN n_name END", "'district_not_established'"),
        ("where", "statedLocation", "text", "NULL", unread),
        ("where", "pincode", "text", "CASE WHEN o_custkey % 3 != 0 THEN CAST(o_custkey % 1000 + 400000 AS VARCHAR) END", unread),
        ("where", "workSite", "text", "NULL", "'site_not_stated'"),
        ("who", "department", "text", "o_orderpriority", unread),
        ("who", "issuingOffice", "chain", "CASE WHEN o_custkey % 6 != 0 THEN 'State||' || c_name END", unread),
        ("who", "bidders", "text", "NULL", "'award_not_collected'"),
        ("who", "winner", "text", "NULL", "'award_not_collected'"),
        ("money", "estimatedValue", "rupees", "CASE WHEN o_orderstatus != 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) END", unread),
        ("money", "bidSecurity", "rupees", "NULL", unread),
        ("money", "tenderFee", "as_printed", on_page("CASE WHEN o_orderkey % 5 = 0 THEN 'Exempted' ELSE '₹' || (o_orderkey % 1000) END"), unread),
        ("money", "winningBid", "rupees", "NULL", "'award_not_collected'"),
        ("money", "contractValue", "rupees", "NULL", "'award_not_collected'"),
        ("money", "amountPaid", "rupees", "NULL", "'progress_not_available'"),
        ("when", "published", "as_printed", on_page("day"), unread),
        ("when", "documentsAvailable", "as_printed", on_page("day || CASE WHEN o_custkey % 3 = 1 THEN ' to until sold' ELSE '' END"), unread),
        ("when", "preBidMeeting", "as_printed", on_page("CASE WHEN o_custkey % 5 = 2 THEN 'Hall 2' END"), unread),
        ("when", "bidsClose", "date", "CASE WHEN o_orderkey % 11 != 0 THEN day END", unread),
        ("when", "bidsOpen", "date", "NULL", unread),
        ("when", "periodOfWork", "as_printed", on_page("CAST(o_custkey % 400 AS VARCHAR)"), unread),
        ("when", "workProgress", "text", "NULL", "'progress_not_available'"),
    ]
    return ", ".join(f"{{'place': {i}, 'section': '{s}', 'field': '{n}', 'kind': '{k}', 'value': CAST({v} AS VARCHAR), 'why': {w}}}" for i, (s, n, k, v, w) in enumerate(fields))


_SECTION = "string_agg(f.field || coalesce('=' || f.kind || ':' || f.value, '!' || f.why), ';' ORDER BY f.place) FILTER (WHERE f.section = '{0}') AS {0}_section"
_SOURCE = """WITH o AS (SELECT *, o_custkey AS export_id, CAST(o_totalprice AS DECIMAL(20,2)) AS price,
  CASE WHEN o_custkey % 23 = 0 THEN 'year_not_stated' WHEN o_custkey % 17 = 0 THEN 'unit_not_thousands' WHEN o_custkey % 13 = 0 THEN 'no_header' WHEN o_custkey % 19 = 0 THEN 'missing_columns' WHEN o_custkey % 29 = 0 THEN 'no_rows' END AS refusal FROM orders)"""

SQL = {
    "tender_records": f"""WITH d AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT o_orderkey AS id, unnest([{_fields()}]) AS f FROM d),
s AS (SELECT id, {", ".join(_SECTION.format(s) for s in SECTIONS)} FROM e GROUP BY id),
m AS (SELECT id, string_agg(why || ':' || names, ';' ORDER BY place) AS missing FROM (SELECT id, f.why AS why, min(f.place) AS place, string_agg(f.field, ',' ORDER BY f.place) AS names FROM e WHERE f.value IS NULL GROUP BY 1, 2) GROUP BY id),
c AS (SELECT l_orderkey AS id, count(*) - 1 AS changes FROM lineitem GROUP BY 1)
SELECT s.*, m.missing, coalesce(c.changes, 0) AS changes, CASE WHEN d.o_orderkey % 11 = 0 THEN 'unknown' WHEN CAST(d.day AS TIMESTAMP) > TIMESTAMP '{AS_OF}' THEN 'open' ELSE 'closed' END AS status
FROM s JOIN d ON d.o_orderkey = s.id JOIN m ON m.id = s.id LEFT JOIN c ON c.id = s.id""",
    "budget_finance": f"""{_SOURCE} SELECT 'D' || (o_custkey % 50) AS dept_code, '7' AS demand_no, left(o_orderpriority, 1) AS scheme_code, 'O' || (o_orderkey % 100) AS object_code, CAST(2010 + o_custkey % 9 AS INTEGER) AS fiscal_year, export_id,
  CASE WHEN o_custkey % 3 != 0 AND o_orderkey % 7 != 0 THEN 'Scheme ' || o_orderpriority END AS name_en, CAST(price * 1000 AS DECIMAL(20,2)) AS allocated_inr, CASE WHEN o_custkey % 3 != 0 THEN CAST(price * 1000 AS DECIMAL(20,2)) END AS released_inr,
  CASE WHEN o_orderstatus != 'O' THEN CAST(price * 1000 AS DECIMAL(20,2)) END AS utilized_inr, CASE WHEN o_custkey % 3 != 0 AND o_orderkey % 5 = 0 THEN CAST(-5250 AS DECIMAL(20,2)) END AS reappropriated_inr
FROM o WHERE refusal IS NULL QUALIFY row_number() OVER (PARTITION BY 1, o_custkey % 50, scheme_code, o_orderkey % 100, fiscal_year ORDER BY o_custkey DESC, o_orderkey DESC) = 1""",
    "budget_refusals": f"{_SOURCE} SELECT DISTINCT export_id, refusal FROM o WHERE refusal IS NOT NULL",
}
