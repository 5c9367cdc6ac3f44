"""Listing pages on small, odd input: what each reader takes, what it refuses, where a run stops."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tables
from ledgerloom.operators import listings

V = listings.CLASS_PREFIX
HEADS = "".join(f'<th class="views-field {V}{listings.CLASS_COLUMNS[n]}">' for n in listings.CLASS_NEEDED)
ORDERED = '<table class="tablepress"><tr>' + "".join(f"<th>{h.title()}</th>" for h in listings.ORDERED_HEADERS) + "</tr>"
DIRECTORY = "<table><tr>" + "".join(f"<th>{h}</th>" for h in listings.DIRECTORY_HEADERS) + "</tr>"


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def test_structure_of_loose_and_nested_tables(spark):
    html = "<table class='a b'><tr><td>x<!-- no --> &amp;\n y<td><table><tr><th>in</table>z<a href='q'>w</a><script>no<</script><tr><td>last</table>text<a href=p>"
    r = pages(spark, html, None, "").select(tables.structure("html").alias("s")).collect()
    rows = [(x.place, x.styles, [(c.head, c.text, c.links) for c in x.cells]) for x in r[0].s.rows]
    assert rows == [(0, ["a", "b"], [(False, "x & y", []), (False, "inzw", ["q"])]), (1, [], [(True, "in", [])]), (0, ["a", "b"], [(False, "last", [])])]
    assert r[0].s.links == ["q", "p"] and r[1].s.rows == r[2].s.rows == [] and r[1].s.links == []


def test_columns_by_class_wherever_they_stand(spark):
    row = f'<tr><td class="{V}title-1">Road<td class="{V}field-tender-date-1">3 May 2026<td><a href="a.pdf"></a><a href="/a.pdf">x</a><a href="http://h/b.PDF?x=1">'
    html = f'<a href="?page=4"><a href="?q=1&amp;page=11"><table class="views-table"><thead><tr>{HEADS}</thead><tbody>{row}{row}</tbody></table>'
    got = listings.rows(listings.by_class(pages(spark, html), "https://o")).collect()
    assert len(got) == 2 and got[0].last_page == 11 and got[0].place == 0
    assert (got[0].title, got[0].published, got[0].reference) == ("Road", "3 May 2026", "") and got[0].documents == ["https://o/a.pdf", "http://h/b.PDF?x=1"]


def test_class_refusals(spark):
    body = "<tbody><tr><td>x</tbody></table>"
    html = [None, "", f'<table class="other"><tr>{HEADS}{body}', f'<table class="views-table"><tr><th>x</tr>{body}', f'<table class="views-table"><thead><tr>{HEADS}</thead><tbody></tbody></table>']
    got = listings.refusals(listings.by_class(pages(spark, *html), "https://o")).orderBy("page_id").collect()
    assert [r.refusal for r in got] == ["no_table", "no_table", "no_table", "missing_columns", "no_rows"]


def test_columns_in_exact_order(spark):
    row = '<tr><td>1<td>6 July-2026 at 12:00 PM<td>8-Mar-2026<td> Work\n<td><a href=" https://h/a.pdf ">n</a><a href="/b.pdf">n</a><tr><td>note'
    html = [ORDERED + row, ORDERED.replace("Sr. No", "No") + row, ORDERED, "<p>"]
    read = listings.by_headers(pages(spark, *html))
    (got,) = listings.rows(read).collect()
    assert (got.serial, got.title, got.documents) == ("1", "Work", ["https://h/a.pdf"])
    assert [r.refusal for r in listings.refusals(read).orderBy("page_id").collect()] == ["unexpected_columns", "no_rows", "no_table"]


@pytest.mark.parametrize("text, day", [("6 July-2026 at 12", (2026, 7, 6)), ("20-Jun-2024", (2024, 6, 20)), ("1 Sept 2024", (2024, 9, 1)), ("31 Sep 2024", None), ("08-03-2023", None), ("1 Juny 2024", None), (None, None)])
def test_leading_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(listings.leading_date(F.col("t")), listings.full_date(F.col("t"))).first()
    assert got[0] == (day and dt.date(*day)) and got[1] is None


def directory_row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_directory(spark):
    good = directory_row(1, 27, "Pune", "पुणे", "state", "-", "12") + directory_row("note", 1) + directory_row(2, 28, "Assam", "ASSAM", "UT", "na", "")
    row = listings.rows(listings.directory(pages(spark, DIRECTORY + good))).orderBy("place").collect()
    assert [tuple(r)[2:] for r in row] == [("27", "Pune", "पुणे", "STATE", None, "12"), ("28", "Assam", None, "UT", None, None)]
    bad = [None, DIRECTORY.replace("State or UT", "Kind") + good, DIRECTORY + directory_row(1, "x", "A", "", "UT", "", ""), DIRECTORY + directory_row(1, 2, "", "", "UT", "", ""), DIRECTORY + directory_row(1, 2, "A", "", "City", "", ""), DIRECTORY, DIRECTORY + directory_row(1, 2, "A", "", "UT", "", "") * 2]
    got = listings.refusals(listings.directory(pages(spark, *bad))).orderBy("page_id").collect()
    assert [r.refusal for r in got] == ["missing_columns", "missing_columns", "code_not_numeric", "no_name", "kind_unknown", "no_rows", "code_twice"]


def test_a_run_stops_after_a_page_without_news(spark):
    listed = [("a", 1, "u"), ("a", 1, "u"), ("a", 2, "u"), ("a", 2, "held"), ("a", 3, "new"), ("b", 1, "u"), ("b", 2, "v"), ("c", 5, "held")]
    df = spark.createDataFrame(listed, "agency string, page int, url string")
    got = listings.collect(df, spark.createDataFrame([("held",), ("held",), (None,)], "url string")).orderBy("agency").collect()
    assert [tuple(r) for r in got] == [("a", 2, 4, 1, 3), ("b", 2, 2, 2, 0), ("c", 1, 1, 0, 1)]
    assert listings.collect(df.where("1 = 0"), df.select("url")).count() == 0
