"""What a review found: ties, references that hold a year, plans that grow faster than their input."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from ledgerloom.functions import markup, money, notices, page_facts, tables, tender_record, text
from ledgerloom.llm import line_dedup
from ledgerloom.operators import actuals, budget, gazetteer, reconcile
from ledgerloom.plans import finance


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_names_are_sent_and_not_the_runs_of_pages(spark, tmp_path):
    spark.range(10).select("id", F.lit("Work near Nagar, and more").alias("text")).write.parquet(str(tmp_path / "pages"))
    names = spark.createDataFrame([("Nagar", "district"), ("Nagar Haveli", "district")], "name string, level string")
    found = gazetteer.places_in(spark.read.parquet(str(tmp_path / "pages")), gazetteer.unambiguous(names))
    assert [r.value for r in found.collect()] == ["Nagar district"] * 10
    assert "BuildRight" in plan_of(found) and "BuildLeft" not in plan_of(found)


def test_a_reference_whose_number_looks_like_a_year(spark):
    pages = spark.createDataFrame([("No. MSIDC/Mumbai/ 2012 /2026 Sd/-",), ("No. MSIDC/1999/Mumbai/ 7 / 2026 ( 2nd Call )",)], "t string")
    got = [r.v for r in pages.select(F.transform(notices.letter(F.col("t")), lambda r: r["value"]).alias("v")).collect()]
    assert got == [["MSIDC/Mumbai/2012/2026"], ["MSIDC/1999/Mumbai/7/2026(2ndCall)"]]


def test_equal_ids_are_planned_by_what_they_carry(spark):
    schema = "id int, doc int, flag string"
    source = spark.createDataFrame([(1, 1, "A"), (1, 1, "B")], schema).coalesce(1)
    target = spark.createDataFrame([(1, 1, "B"), (1, 1, "A")], schema).coalesce(1)
    plan = reconcile.refresh_plan(source, target, ["doc"], ["flag"], F.lit(False))
    assert [r.action for r in plan.collect()] == ["keep", "keep"]


def test_a_crowded_hour_is_counted_by_running_counts(spark):
    times = [*range(0, 7300, 5), 3600, 3600, 7200]
    requests = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, s int").select("id", F.timestamp_seconds("s").alias("at"))
    paced = reconcile.paced(requests, "at", 4)
    assert {r.id: r.recent for r in paced.collect()} == {i: sum(t - 3600 <= u < t for u in times) for i, t in enumerate(times)}
    assert all("unboundedpreceding" in part for part in plan_of(paced).lower().split("specifiedwindowframe(")[1:])


def test_plain_pages_are_read_as_others_are_and_a_few_at_a_time(spark):
    row = "<tr><td class='c d'>a &amp; b<td><a href=\"/x?a=1&amp;b=2\">n</a><table><tr><th>in</table>z</td></tr>"
    html = "<table class=\"t\"><thead><tr><th>h</thead><tbody>" + row * 3 + "</tbody></table><a href='p'>"
    assert not any("<" in t for t in tables._PLAIN_TAG.split(html)[::2])
    frame = spark.createDataFrame([(html,), (html + "<script></script>",)], "html string").coalesce(1)
    plain, other = (r.s for r in tables.bounded(frame).select(tables.structure("html").alias("s")).collect())
    assert plain == other and len(plain.rows) == 7 and plain.links == ["/x?a=1&b=2"] * 3 + ["p"]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= tables.BATCH_PAGES


def test_matches_of_a_page_keep_their_places_where_white_space_is_undone(spark):
    page = " \n Paid ₹ 12  crore \t to M/s Firm Ab Works, Pune.\n\nRs. 5 by the   Collector.\x0b Work of \n\n Irrigation  Department. Government of Goa"
    found = spark.createDataFrame([(page,), (None,)], "t string").select(page_facts.located_matches("t").alias("f")).collect()
    got = [(m.kind, " ".join(page[m.char_start : m.char_end].split()), m.sentence[m.at : m.to].strip()) for m in found[0].f]
    assert {k for k, _, _ in got} == {"amount", "contractor_reference", "officer_role_reference", "department", "government"} and found[1].f == []
    assert all(source == flat for _, source, flat in got)


def test_an_export_is_taken_apart_once(spark):
    html = "<tr><td>Financial Year 2020<tr><td>Amounts in Thousands<tr><th>" + "<th>".join(budget.REQUIRED) + "<tr><td>1<td>2<td>3<td>4<td>5<td>6"
    parsed = budget.parse(spark.createDataFrame([(1, html)], "export_id int, html string"))
    assert [r.allocated_inr for r in budget.figures(parsed).collect()] == [5000]
    assert plan_of(budget.figures(parsed)).count("(?i)<tr[^>]*>") == 1


def test_a_crowded_bucket_is_paired_whole(spark):
    sketched = spark.createDataFrame([(1, 20, 0, 7), (2, 20, -1, 7)], "h long, n long, near long, far long")
    dealt = spark.createDataFrame([(1, 9, 5000), (2, 9, 5000)], "h long, bucket long, m long")
    named = spark.createDataFrame([], "h long, component long")
    assert [tuple(r) for r in line_dedup._inside(dealt, sketched, named, 80).collect()] == [(1, 2)]


def test_a_page_cleaned_at_once_is_read_as_cell_by_cell(spark):
    odd = ["a < b", "x</td> y", "</b", "&nbsp; &lt;i&gt; &amp;lt;", " z  ", "<b class='td'>q</b>\n r", "1 > 0", "</TR >gone", "&", "", " \t "]
    pages = ["<p>skip<TR><td>" + "<TD align=x>".join(odd) + "<tr\n><tr><th>h</th><tr>no cell", "<td>no row", "", "<tr><td <tr><td>open <i", None]
    hard = ["<tr><td>&#38;#60;<td>&#60; &#1;", "<tr><td>\x01a<td>\x02 b"]
    frame = spark.createDataFrame([(p,) for p in pages + hard], "html string")
    html, parts = F.col("html"), F.split("html", "(?i)<tr[^>]*>")
    got = frame.select(markup.rows_by_split(html).alias("rows"), markup._cells_by_cell(parts).alias("want"), markup._cells_at_once(parts).alias("at_once")).collect()
    assert [r.rows for r in got] == [r.want for r in got] and got[0].rows[0][2:4] == ["</b", "<i> &lt;"] and len(got[0].rows) == 2
    assert [r.at_once for r in got[: len(pages)]] == [r.want for r in got[: len(pages)]]
    assert plan_of(actuals.parse(frame.selectExpr("1 AS report_id", "1 AS unit_id", "2020 AS fiscal_year", "html"))).count("<t[dh][^>\x01]*>") == 1


def test_a_record_is_made_a_section_at_a_time(spark):
    named = "id title tender_category product_category tender_type location pincode district_name district_source department organisation_chain value_inr emd_inr closing_at bid_opening_at"
    rows = spark.range(2).select(*[(F.col("id") if c == "id" else F.concat(F.lit(c), F.col("id").cast("string"))).alias(c) for c in named.split()])
    rows = rows.withColumn("detail_fields", F.when(F.col("id") == 0, F.create_map(F.lit("Tender Fee"), F.lit("12"))))
    made = tender_record.with_fields(rows, ["id"]).orderBy("id").collect()
    assert [r.fields for r in made] == [r.fields for r in rows.orderBy("id").select(tender_record.record(F.col("detail_fields")).alias("fields")).collect()]
    assert all(r.fields == r.what_fields + r.where_fields + r.who_fields + r.money_fields + r.when_fields and len(r.fields) == 27 for r in made)
    assert [f.value for f in made[0].money_fields if f.field == "tenderFee"] == ["₹12"]


def test_a_figure_is_read_once(spark):
    texts = ["1,234.5", " -0012.00 ", "NA", None, "x", "1.2345678901", "9" * 29, "9" * 30, "0" * 40 + "1", "1\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(money.published_to_paise(F.col("t"), "crores").alias("p")).collect()
    want = [(1234500000000, None), (-12000000000, None), (None, None), (None, None), (None, "not an amount"), (None, "sub-paise precision"), (int("9" * 29 + "0" * 9), None), (None, "too many digits"), (10**9, None), (None, None)]
    assert [(None if r.p.paise is None else int(r.p.paise), r.p.refusal) for r in got] == want
    assert "_bound_crore_paise" in plan_of(finance.amounts_to_paise(spark, "/root/testdata/sf0.001"))


def test_halves_of_a_page_are_told_without_an_array_of_its_letters(spark):
    pages = ["कख ab", "कखग ab", "", "१ 😀", "٣é", None, "क\nख\nA"]
    rows = spark.createDataFrame([(p,) for p in pages], "t string").select("t", text.half_of_page(F.col("t")).alias("half"), text.script_of(F.col("t")).alias("script"))
    assert [r.half for r in rows.collect()] == ["latin", "devanagari", "latin", "devanagari", "latin", "latin", "devanagari"]
    assert [r.script for r in rows.collect()] == ["mixed", "mixed", "none", "devanagari", "latin", "none", "mixed"]
    assert "regexp_extract_all" not in plan_of(rows)
