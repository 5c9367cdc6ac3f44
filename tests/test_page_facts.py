"""Fact driver: cleaned pages with moved spans, refused scales, places in the page."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import page_facts


def found(spark, *pages: str | None, items=None) -> list:
    rows = [(1, i + 1, p) for i, p in enumerate(pages)]
    return page_facts.candidates(spark.createDataFrame(rows, "document_id bigint, page_number int, content string")).collect()


@pytest.mark.parametrize(
    ("page", "value", "confidence"),
    [
        ("एकूण यनधी ₹ 27,559.26 कोटी होता.", "27559260000000", 0.8),
        ("Total annual Rent for both the offices: ₹1,53,427 was paid.", "15342700", 0.6),
        ("Table 2.6: Unnecessary Allocation (₹ in crore) Sr. No. 1. A-2 ₹ 5376.31 for the year.", None, 0.4),
        ("परिशिष्ट 2.7 मोठ्या बचती (₹ कोटीत) अनु. क्र. ₹ 5376.31 आहे.", None, 0.4),
        ("A sum of ₹ 12.34 lacs was spent", None, 0.4),
        ("A sum of ₹ 12.34 core was spent", None, 0.4),
        ("A sum of ₹ 12 தொகை was spent", None, 0.4),
        ("A sum of ₹ 12. 50 crore was spent", None, 0.4),
        ("A sum (₹ 40 of the total) crore was spent", None, 0.4),
        ("A sum (₹ 40 of the total) was spent", "4000", 0.6),
        ("A sum of ₹ 1.234 was spent", None, 0.4),
    ],
)
def test_scales(spark, page, value, confidence):
    (only,) = [r for r in found(spark, page) if r["kind"] == "monetary_amount"]
    assert (only["normalised_value"], float(only["confidence"])) == (value, confidence)


def test_headings_and_lost_marks(spark):
    assert found(spark, "Name of Institution Amount in ₹ 1 Academy of Nursing") == []
    assert [r["normalised_value"] for r in found(spark, "paid ` 5 crore here")] == []
    two = found(spark, "paid ` 5 crore here and ´ 7 there")
    assert [(r["normalised_value"], float(r["confidence"])) for r in two] == [("50000000" + "00", 0.5), ("700", 0.3)]


def test_other_kinds_and_first_mentions(spark):
    page = "The Executive Engineer, Pune stated that M/s Acme Builders was paid by the Water Supply Department."
    rows = found(spark, page, page, None, "", "\x01\x02 ")
    kinds = sorted((r["kind"], r["page_number"], r["normalised_value"]) for r in rows)
    assert kinds == [
        ("body_reference", 1, "Water Supply Department"), ("contractor_reference", 1, "Acme Builders"), ("contractor_reference", 2, "Acme Builders"),
        ("officer_role_reference", 1, "Executive Engineer, Pune"), ("officer_role_reference", 2, "Executive Engineer, Pune"),
    ]


def brute_clean(raw: str) -> tuple[str, list[int]]:
    """The cleaned text, and for each raw character its place there or -1."""
    kept = [(i, c) for i, c in enumerate(raw) if not re.match(page_facts.UNSTORABLE, c)]
    text = "".join(c for _, c in kept)
    lead = len(text) - len(text.lstrip())
    content = text.strip()
    place = [-1] * len(raw)
    for at, (i, _) in enumerate(kept):
        if lead <= at < lead + len(content):
            place[i] = at - lead
    return content, place


def test_cleaning_moves_items(spark):
    draw = random.Random(3)
    raws = ["", " ", "\x01", "a\x01\x02b", *("".join(draw.choice("ab \n\x00\x01\x1f₹é") for _ in range(draw.randint(0, 40))) for _ in range(120))]
    spans = [[sorted(draw.sample(range(len(r) + 1), 2)) for _ in range(4)] if r else [] for r in raws]
    rows = [(i, r, [(a, b, 0.0, 0.0, float(a), float(b)) for a, b in s]) for i, (r, s) in enumerate(zip(raws, spans, strict=True))]
    df = spark.createDataFrame(rows, "id int, raw string, items array<struct<char_start:int,char_end:int,x0:double,y0:double,x1:double,y1:double>>")
    clean = df.withColumn("c", page_facts.cleaned(F.col("raw")))
    for r in clean.select("id", "c.content", page_facts.moved_items(F.col("items"), F.col("c")).alias("items")).collect():
        content, place = brute_clean(raws[r["id"]])
        want = []
        for a, b in spans[r["id"]]:
            alive = [place[i] for i in range(a, b) if place[i] >= 0]
            if alive:
                want.append((alive[0], alive[-1] + 1, float(a), float(b)))
        assert r["content"] == content and [(i["char_start"], i["char_end"], i["x1"], i["y1"]) for i in r["items"]] == want


def test_spans_and_boxes_lie_where_the_page_prints_them(spark):
    raw = "\x02 Intro line.\n The  sum of\x01 ₹ 12.34\n crore went to M/s  Acme Works, Pune. Later ₹ 5 lakh.\x03"
    words = [(m.start(), m.end(), float(m.start()), 0.0, float(m.end()), 1.0) for m in re.finditer(r"[^\s\x00-\x08,.]+", raw)]
    df = spark.createDataFrame([(1, 1, raw, words)], "document_id int, page_number int, content string, items array<struct<char_start:int,char_end:int,x0:double,y0:double,x1:double,y1:double>>")
    content, place = brute_clean(raw)
    rows = page_facts.candidates(df, items="items").collect()
    assert sorted(content[r["char_start"] : r["char_end"]] for r in rows) == ["M/s  Acme Works", "₹ 12.34\n crore", "₹ 5 lakh"]
    for r in rows:
        assert (place.index(r["char_start"]), place.index(r["char_end"] - 1) + 1) == (int(r["box"]["x0"]), int(r["box"]["x1"]))
