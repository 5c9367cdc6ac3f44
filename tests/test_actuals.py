"""Department actuals on small reports: what is read, what is refused, what a later report replaces."""

from __future__ import annotations

from decimal import Decimal

import pytest

from ledgerloom.operators import actuals

UNIT = "<tr><td>Amount in Crores</td></tr>"
HEAD = "<tr><td>Department</td><td>Budgeted</td><td>Released</td><td>BEAMS Expenditure</td></tr>"
ROW = "<tr><td>H -Public Works</td><td>1.000</td><td>-</td><td>36,986.262</td></tr>"
TOTAL = "<tr><td>Total</td><td>1</td><td>1</td><td>1</td></tr>"


def parsed(spark, *pages):
    rows = [(i + 1, 7, 2024, html) for i, html in enumerate(pages)]
    return actuals.parse(spark.createDataFrame(rows, "report_id long, unit_id long, fiscal_year int, html string"))


def test_first_table_only_and_a_missing_figure_is_null(spark):
    second = ROW.replace("1.000", "9.000")
    (row,) = actuals.figures(parsed(spark, f"<table>{UNIT}{HEAD}{ROW}{TOTAL}{HEAD}{second}</table>")).collect()
    assert (row.dept_code, row.name_en, row.from_month, row.to_month) == ("H", "Public Works", 4, 3)
    assert row.budgeted_inr == Decimal("10000000.00") and row.released_inr is None and row.received_inr is None
    assert row.spent_inr == Decimal("369862620000.00")


def test_columns_follow_their_names_and_months_are_read(spark):
    head = "<tr><th>department<th>BEAMS Expenditure<th>x<th>released<th>BUDGETED<th>Received"
    row = "<tr><td>HR — Law, Order<td>1<td>2<td>3<td>4<td>5"
    (got,) = actuals.figures(parsed(spark, f"<table><tr><td>Yearly Budget july -  SEPTEMBER{UNIT}{head}{row}</table>")).collect()
    assert (got.from_month, got.to_month, got.dept_code, got.name_en) == (7, 9, "HR", "Law, Order")
    assert [int(v / 10**7) for v in (got.released_inr, got.budgeted_inr, got.received_inr)] == [3, 4, 5]


@pytest.mark.parametrize(
    "page, why",
    [
        (None, "unit_not_crores"),
        ("", "unit_not_crores"),
        (f"<table>{HEAD}{ROW}</table>", "unit_not_crores"),
        (f"<table>{UNIT}<tr><td>X</td></tr></table>", "no_header"),
        (f"<table>{UNIT}{HEAD.replace('>Budgeted<', '>Something<')}{ROW}</table>", "missing_columns"),
        (f"<table>{UNIT}{HEAD}{ROW.replace('1.000', '1.0000000001')}</table>", "amount_not_exact"),
        (f"<table>{UNIT}{HEAD}</table>", "no_rows"),
        (f"<table>{UNIT}{HEAD}{TOTAL}{ROW}</table>", "no_rows"),
        (f"<table>{UNIT}{HEAD}{ROW}{ROW}</table>", "department_twice"),
    ],
)
def test_refusals(spark, page, why):
    p = parsed(spark, page)
    assert [r.refusal for r in actuals.refusals(p).collect()] == [why] and actuals.figures(p).count() == 0


def test_a_later_report_replaces_the_whole_row_and_a_replay_nothing(spark):
    page = f"<table>{UNIT}{HEAD}{ROW}</table>"
    both = actuals.figures(parsed(spark, page, page.replace("36,986.262", "-").replace("Public Works", "Works")))
    first, second = both.where("report_id = 1"), both.where("report_id = 2")
    orders = [actuals.load(actuals.load(None, first), second), actuals.load(actuals.load(None, second), first), actuals.load(actuals.load(None, both), first)]
    for stored in orders:
        (row,) = stored.collect()
        assert (row.report_id, row.name_en, row.spent_inr) == (2, "Works", None)


def test_a_department_beside_its_schemes(spark):
    page = f"<table>{UNIT}{HEAD}{ROW}<tr><td>C - Revenue<td>3<td>2<td>0.5</table>"
    stored = actuals.load(None, actuals.figures(parsed(spark, page)))
    schemes = spark.createDataFrame([(7, "C", 2024, Decimal("5.00")), (7, "C", 2024, None), (7, "C", 2023, Decimal(1)), (7, "H", 2024, None)], "unit_id long, dept_code string, fiscal_year int, allocated_inr decimal(20,2)")
    rows = {r.dept_code: r for r in actuals.by_department(stored, schemes).collect()}
    assert rows["C"].allocated_alternate_inr == 5 and rows["C"].release_variance_inr == Decimal("15000000.00") and rows["C"].status == "complete"
    assert rows["H"].allocated_alternate_inr is None and rows["H"].release_variance_inr is None and rows["H"].status == "insufficient_data"
    assert [r.dept_code for r in actuals.by_department(stored, schemes, 7, "C").collect()] == ["C"]
    assert actuals.by_department(stored, schemes, 8).count() == 0
