"""Refusals from a page's outline are those of the whole reading."""

from __future__ import annotations

import re

from ledgerloom.functions import page_facts, tables, text
from ledgerloom.operators import listings

HEADS = "<tr><th>Sr. No<th>Publication  <b>Date</b><th>Last Date/ Time of Submission<th>Name of Work<th>Tender Notice"
ROW = '<tr><td>1<td>2<td>3<td>4<td><a href="https://d.example/a.pdf">x</a>'
PAGES = [
    f'<table class="tablepress">{HEADS}{ROW}</table>',
    f'<table class="tablepress">{HEADS}<tr><td>1<td>2</table>',
    f'<table class="tablepress">{HEADS.replace("Sr. No", "No")}{ROW}</table>',
    f'<table class="tablepress"><tr><td>x<table class="inner">{HEADS}</table>{ROW}</table>',
    f'<table class="tablepress"><tr><th>Sr. <table><tr><td>No</table>{HEADS[15:]}{ROW}</table>',
    f'<script>x</script><table class="tablepress">{HEADS}{ROW}</table>',
    "<p>nothing</p>", None,
]


def test_refusals_need_only_the_outline(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id int, html string")
    for reader in (listings.by_headers, lambda p, whole: listings.by_class(p, "https://o.example", whole)):
        got = [sorted(map(tuple, listings.refusals(reader(pages, whole=whole)).collect())) for whole in (True, False)]
        assert got[0] == got[1] and got[0]
    rows, links = tables._read(PAGES[0], outline=True)
    assert [c["text"] for c in rows[1]["cells"]] == [None] * 5 and rows[0]["cells"][1]["text"] == "Publication Date"


def test_plain_links_are_read_as_by_the_parser():
    for href in ("x.pdf", " /a b", "<u>y</u>", "?a=1&amp;b=2", "'", ""):
        tag, one = f'<a href="{href}">', tables._Tag(convert_charrefs=True)
        one.feed(tag)
        assert tables._step(tag)[:2] == one.step[:2]


def test_sentences_are_looked_for_at_full_stops_only():
    seen = []

    class Breaks:
        def match(self, flat, at):
            seen.append(flat[at : at + 2])
            return re.compile(text.SENTENCE_BREAK).match(flat, at)

        def finditer(self, flat):
            raise AssertionError("every character is tried")

    patterns = [(kind, re.compile(p.replace("(?U)", ""))) for kind, p in page_facts._KINDS]
    page = "M/s. Firm Xab Works had Rs. 5 lakh.\n\x1f  Government  of Xania had ₹ 7.5 crore. A. ₹ 3"
    got = [(m["kind"], m["sentence"], page[m["char_start"] : m["char_end"]]) for m in page_facts._matches(page, patterns, Breaks())]
    assert set(seen) == {". "} and len(seen) == 5
    assert [g[::2] for g in got if g[0] != "contractor_reference"] == [("amount", "Rs. 5 lakh"), ("amount", "₹ 7.5 crore"), ("government", "Government  of Xania"), ("amount", "₹ 3")]
    assert [s for _, s, _ in got][-3:] == ["Government of Xania had ₹ 7.5 crore", "Government of Xania had ₹ 7.5 crore", "A. ₹ 3"]
