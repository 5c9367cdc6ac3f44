"""Tender records and scheme-budget exports on small, odd input."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import tender_record
from ledgerloom.operators import budget

COLUMNS = "title tender_category product_category tender_type location pincode district_name district_source department organisation_chain value_inr emd_inr closing_at bid_opening_at".split()
HEAD = "<table><tr><td>Financial Year : 2019-2020</td></tr><tr><td>Amounts in thousands</td></tr><tr><th>DEPT<th> Demand_No.<th>SCHEME_CODE<th>OBJECT_CODE<th>budget <th>EXPENDITURE<th>SCHEME_NM"


def fields_of(spark, detail, **values):
    schema = ", ".join(f"{c} string" for c in COLUMNS) + ", detail map<string, string>"
    rows = spark.createDataFrame([(*[values.get(c) for c in COLUMNS], detail)], schema)
    return rows.select(tender_record.record(F.col("detail")).alias("f")).select("f", tender_record.missing_by_reason(F.col("f")).alias("m")).first()


def test_a_page_never_read_is_another_reason_than_a_silent_page(spark):
    unread = {f.field: f for f in fields_of(spark, None, title="Road").f}
    silent = {f.field: f for f in fields_of(spark, {}, title="Road").f}
    assert len(unread) == 27 and unread["title"].value == "Road" and unread["title"].why is None
    assert unread["tenderFee"].why == unread["pincode"].why == "detail_not_read"
    assert silent["tenderFee"].why == silent["pincode"].why == "not_on_page"
    assert unread["workSite"].why == silent["workSite"].why == "site_not_stated"
    assert all((f.value is None) == (f.why is not None) == (f.kind is None) for f in unread.values())


def test_labels_in_order_fees_and_joined_fields(spark):
    detail = {"Work Description": " ", "Work Item Description": " Drains ", "Tender Fee": "1,180.00", "Pre Bid Meeting Address": "Hall 2", "Document Download Start Date": "1 May", "Document Download / Sale End Date": "9 May"}
    f = {x.field: x.value for x in fields_of(spark, detail, title="t", organisation_chain="State || || PWD||").f}
    assert f["workDescription"] == "Drains" and f["tenderFee"] == "₹1,180.00" and f["preBidMeeting"] == "Hall 2"
    assert f["documentsAvailable"] == "1 May to 9 May" and f["issuingOffice"] == "State||PWD"


def test_a_district_needs_its_method_and_reasons_come_once(spark):
    row = fields_of(spark, {}, title="t", district_name="Pune")
    reasons = [m.why for m in row.m]
    assert len(reasons) == len(set(reasons)) and reasons[0] == "not_on_page"
    assert dict((m.why, m.fields) for m in row.m)["district_not_established"] == ["officeDistrict"]
    assert dict((m.why, m.fields) for m in row.m)["award_not_collected"] == ["bidders", "winner", "winningBid", "contractValue"]


def test_status_and_changes(spark):
    rows = spark.createDataFrame([(1, "2020-01-02"), (2, "2020-01-01"), (3, None)], "id long, c string")
    readings = spark.createDataFrame([(1,), (1,), (1,), (2,)], "tender_id long")
    got = tender_record.with_changes(rows.withColumn("s", tender_record.status(F.to_timestamp("c"), F.lit("2020-01-01").cast("timestamp"))), readings).orderBy("id").collect()
    assert [(r.s, r.changes) for r in got] == [("open", 2), ("closed", 0), ("unknown", 0)]


def exports(spark, *pages):
    return budget.parse(spark.createDataFrame(list(enumerate(pages)), "export_id long, html string"))


def test_rows_by_names_missing_cells_and_subtotals(spark):
    page = HEAD + "<tr><td>D1<td>7<td>S<td>O<td>1,234.5<td>-" + "<tr><td>D1<td>7<td>S<td>P<td>x<td>2<td>null" + "<tr><td>Total<td><td><td><td>9<td>9" + "<tr><td>D1<td>7<td>S"
    got = budget.figures(exports(spark, page)).orderBy("place").collect()
    assert [(r.object_code, r.fiscal_year, r.allocated_inr, r.utilized_inr, r.name_en) for r in got] == [("O", 2019, Decimal("1234500.00"), None, None), ("P", 2019, None, Decimal("2000.00"), None)]


def test_the_last_statement_of_a_key_stays(spark):
    row = "<tr><td>D1<td>7<td>S<td>O<td>{}<td>1"
    got = budget.finance(budget.figures(exports(spark, HEAD + row.format(1) + row.format(2), HEAD + row.format(3)))).collect()
    assert [r.allocated_inr for r in got] == [Decimal("3000.00")]


def test_refused_whole_in_the_order_of_the_reasons(spark):
    row = "<tr><td>D1<td>7<td>S<td>O<td>1<td>1"
    pages = [
        (HEAD + row).replace("2019-2020", "this year"),
        (HEAD + row).replace("thousands", "crores"),
        (HEAD + row).replace("<th>DEPT", "<th>DEPTS"),
        (HEAD + row).replace("budget ", "outlay"),
        HEAD,
        HEAD + row,
        None,
        "",
    ]
    parsed = exports(spark, *pages)
    got = {r.export_id: r.refusal for r in budget.refusals(parsed, budget.figures(parsed)).collect()}
    assert got == {0: "year_not_stated", 1: "unit_not_thousands", 2: "no_header", 3: "missing_columns", 4: "no_rows", 6: "year_not_stated", 7: "year_not_stated"}


def test_empty_tables(spark):
    parsed = budget.parse(spark.createDataFrame([], "export_id long, html string"))
    assert budget.finance(budget.figures(parsed)).count() == 0 and budget.refusals(parsed, budget.figures(parsed)).count() == 0
