"""Notices, stated facts, gazetteer, robots and page geometry on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import facts, notices, page_geometry
from ledgerloom.operators import gazetteer, robots


def one(spark, value: str, **columns):
    return spark.createDataFrame([(value,)], "v string").select(*[c.alias(n) for n, c in columns.items()]).first()


def test_printout_and_letters(spark):
    page = "Tender Reference Number  X/1 of  2026\nTender ID 2026_ABC_123_1\nTender Value in ₹ 1,50,79,073\nEMD Amount in ₹ 12,34,56\nTotal Fee in ₹ * - 500.00\nFinancial Bid Opening Date 16-Mar-2026 05:00 PM Bid Opening Date 15-Mar-2026 12:30 AM"
    got = {(r.field, r.value) for r in one(spark, page, r=notices.readings(F.col("v"))).r}
    assert got == {("tender_reference_number", "X/1 of 2026"), ("gepnic_tender_id", "2026_ABC_123_1"), ("tender_value", "1507907300"), ("emd", None), ("total_fee", "50000"), ("financial_bid_opening", "2026-03-16T11:30:00.000000Z"), ("bid_opening", "2026-03-14T19:00:00.000000Z")}
    text = "Earnest Money Deposit (EMD): Rs. 1,00,000\nTender Document Fees: INR 1,180/- + GST\nPre-Bid Meeting: 05/09/2026\nStart Date of Publication: 25/08/2026\nई-निविदा सुचना क्र. 12/2026\nनिविदापूर्व बैठक दिनांक : १७.०९.२०२६, दुपारी ३.३०"
    got = {(r.field, r.value, float(r.confidence)) for r in one(spark, text, r=notices.readings(F.col("v"))).r}
    assert got == {("emd", "10000000", 0.8), ("tender_fee_before_gst", "118000", 0.8), ("pre_bid_meeting", "2026-09-05", 0.7), ("publish", "2026-08-25", 0.8), ("issuer_reference", "12/2026", 0.8), ("pre_bid_meeting", "2026-09-17T15:30+05:30", 0.8)}


def test_stated_facts(spark):
    text = "The PWD and Public Works Department, Government of Goa, paid M/s. Acme Roads and Co for work; the Executive Engineer, Panaji Division stated so. The Department General"
    got = one(spark, text, c=facts.contractors(F.col("v")), b=facts.bodies(F.col("v")), o=facts.officers(F.col("v")))
    assert got.c == ["Acme Roads"] and got.b == ["Public Works Department", "Government of Goa"] and got.o == ["Executive Engineer, Panaji Division"]
    page = "(₹ in crore) total ₹ 5376.31 and ₹ 2 crore"
    got = one(spark, page, a=facts.amounts(F.col("v"), F.col("v"))).a
    assert [(a.paise, float(a.confidence)) for a in got] == [(None, 0.4), (2000000000, 0.8)]
    lost = "` 40.80 कोटी and ` 25.96 crore"
    assert [(int(a.paise), float(a.confidence)) for a in one(spark, lost, a=facts.amounts(F.col("v"), F.col("v"))).a] == [(40800000000, 0.5), (25960000000, 0.5)]
    check = lambda value, text: one(spark, text, c=facts.self_check(F.lit(value).cast("decimal(38,0)"), F.col("v"))).c
    assert [check(None, "₹ 1"), check(200, "₹ 1"), check(100, "₹ 1"), check(100, "₹ 1 and ₹ 1"), check(100, "₹ 1 and ₹ 2")] == ["no_value", "mismatch", "confirmed", "confirmed_in_context", "ambiguous"]


def test_gazetteer(spark):
    names = spark.createDataFrame([("Pune District", "district"), ("Nagar", "district"), ("Nagar Haveli", "sub_district"), ("Twin", "sub_district"), ("Twin", "sub_district"), ("Pune", "sub_district"), ("Abc", "sub_district")], "name string, level string")
    kept = gazetteer.unambiguous(names)
    assert {tuple(r) for r in kept.collect()} == {("Pune", "district"), ("Nagar", "district"), ("Nagar Haveli", "sub_district")}
    pages = spark.createDataFrame([(1, "Work in NAGAR HAVELI, (Pune). Also Nagarpur and Nagar. Then Pune"), (2, None)], "id bigint, text string")
    assert {(r.value, r.sentence) for r in gazetteer.places_in(pages, kept).collect()} == {("Nagar Haveli taluka", 0), ("Pune district", 0), ("Nagar district", 1)}
    assert one(spark, "Nagar Haveli Taluka", p=gazetteer.parse_place_value(F.col("v"))).p == ("Nagar Haveli", "sub_district") and one(spark, "district", p=gazetteer.parse_place_value(F.col("v"))).p is None


def test_robots(spark):
    policies = [("a", 200, "text/plain", "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /x # no\nAllow: /x/y\nDisallow: /*.pdf$\nDisallow:"), ("b", 404, None, ""), ("c", 503, None, ""), ("d", 200, "text/html", "<html>"), ("e", 200, None, "User-agent: ledger\nDisallow: /\nUser-agent: *\nAllow: /"), ("f", 200, None, "User-agent: *\nAllow: /p\nDisallow: /p")]
    frame = spark.createDataFrame(policies, "site string, status int, content_type string, body string")
    asked = [("a", "/x/z"), ("a", "/x/y"), ("a", "/k.pdf"), ("a", "/k.pdf?1"), ("b", "/"), ("c", "/"), ("d", "/"), ("e", "/q"), ("f", "/p"), ("g", "/")]
    got = {(r.site, r.path): r.allowed for r in robots.may_fetch(spark.createDataFrame(asked, "site string, path string"), frame, "ledgerloom").collect()}
    assert got == dict(zip(asked, [False, True, False, True, True, False, False, False, False, True], strict=True))


def test_page_geometry(spark):
    box = lambda turn: tuple(one(spark, "", b=page_geometry.raster_to_page(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(60.0), F.lit(72), F.lit(100.0), F.lit(200.0), F.lit(turn))).b)
    assert [box(t) for t in (0, 90, 180, 270)] == [(10, 140, 30, 180), (20, 10, 60, 30), (70, 20, 90, 60), (40, 170, 80, 190)]
    words = spark.createDataFrame([(1, 0, "one", 0.0, 10.0), (1, 1, "two", 1.0, 11.0), (1, 2, "three", 9.0, 19.0)], "page int, seq int, word string, top double, bottom double")
    assert page_geometry.page_text(words, ["page"]).first().content == "one two\nthree"
    assert [(r.char_start, r.char_end) for r in page_geometry.assembled(words, ["page"]).orderBy("seq").collect()] == [(0, 3), (4, 7), (8, 13)]
    assert [one(spark, "", q=page_geometry.quarter_turn(F.lit(x))).q for x in (1, 90, -1, 45, 540)] == [90, 90, 270, None, 180]
    verdicts = [(0.001, 0, 0, 0, "blank"), (0.9, 0, 0, 0, "dark-page"), (0.1, 0, 100, 30, "plate"), (0.1, 50, 100, 0, "text"), (0.1, 5, 100, 0, "sparse")]
    assert all(one(spark, "", v=page_geometry.page_verdict(F.lit(i), F.lit(t), F.lit(r), F.lit(m))).v == w for i, t, r, m, w in verdicts)


def test_letters_are_read_whole(spark):
    text = (
        "No. MSIDC/Mumbai/Tender/ 09 /2026 (R.R.Hande)\nE-TENDER NOTICE NO.06 OF 2023-2024\nPre-Bid Meeting : 17/07/2026 at 12.00 Hrs\n"
        "Tender opening (If possible): 05/05/2026 ; Time - 17.00 Hrs\nDate of Issue of E-Tender Notice : (Online) 03/03/2026 at 24.00 Hrs\n"
        "Tender Ref. No: MSIDC/EOI/EMP-ADV/2026 (2nd Call)\nnotice No.09 Year 2024-25\nNo. MSIDC/x/20261"
    )
    got = sorted((r.field, r.value, float(r.confidence)) for r in one(spark, text, r=notices.letter(F.col("v"))).r)
    assert got == [
        ("bid_opening", "2026-05-05T17:00+05:30", 0.8), ("issuer_reference", "MSIDC/EOI/EMP-ADV/2026(2ndCall)", 0.8), ("issuer_reference", "MSIDC/Mumbai/Tender/09/2026", 0.8),
        ("notice_number", "06 (2023-2024)", 0.8), ("notice_number", "09 (2024-25)", 0.8), ("pre_bid_meeting", "2026-07-17T12:00+05:30", 0.8), ("publish", "2026-03-03", 0.8),
    ]
    for space in ("  ", "\n", "  "):
        page = f"निविदापूर्व बैठक दिनांक : २५.०५.२०२६,{space}सकाळी{space}११.३०"
        assert [r.value for r in one(spark, page, r=notices.marathi(F.col("v"))).r] == ["2026-05-25T11:30+05:30"]
