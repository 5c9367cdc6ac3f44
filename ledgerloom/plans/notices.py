"""Queries over notices printed from the given tables and read back: fields, facts, places, robots decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import facts, markup, notices, text
from ledgerloom.operators import gazetteer, robots
from ledgerloom.sources.ledger import Ledger, with_tables


def notice_fields(spark, sf_dir):
    """Tenders printed as portal notices, with times in India, and their labelled fields read back."""
    t = Ledger(spark, sf_dir).tender
    value = (F.col("tender_value_paise") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").cast("string")
    when = F.date_format("first_seen_at", "dd-MMM-yyyy")
    page = F.concat(F.lit("Tender Reference Number "), F.col("title"), F.lit("\nTender ID 2026_"), F.upper("portal_code"), F.lit("_"), F.col("id"), F.lit("_1\nTender Value in ₹ "), value, F.lit("\nPublish Date "), when, F.lit(" 05:30 AM Financial Bid Opening Date "), when, F.lit(" 12:00 PM"))
    rows = markup.bound(t.repartition("id"), ["id"], page=page).select("id", F.explode(notices.readings(F.col("page"))).alias("r"))
    return rows.select("id", "r.field", "r.kind", "r.value", "r.confidence")


def letter_fields(spark, sf_dir):
    """Orders as letters: a deposit in grouped rupees, a pre-bid meeting whose day may be a month, with and without its
    time, the notice's number and the issuer's reference."""
    o = Ledger(spark, sf_dir).raw("orders")
    page = F.concat(F.lit("Earnest Money Deposit : Rs. "), F.floor("o_totalprice").cast("string"), F.lit("\nPre-Bid Meeting: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.when(F.col("o_orderkey") % 3 == 0, " at noon").when(F.col("o_orderkey") % 3 == 1, " at 12.30 Hrs").otherwise(" ; Time - 25.00 Hrs"))
    number = F.concat(F.lit("\nE-Tender Notice No. "), (F.col("o_orderkey") % 100).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " (2026 - 2027)").otherwise(" OF 2023-24"))
    reference = F.concat(F.lit("\nNo. MSIDC/Mumbai/ "), F.col("o_custkey").cast("string"), F.lit(" /2026"), F.when(F.col("o_orderkey") % 5 == 0, " ( 2nd Call )").otherwise(" Sd/-"))
    page = F.concat(page, number, reference)
    pages = markup.bound(o.repartition("o_orderkey"), ["o_orderkey"], page=page)
    rows = pages.select(F.col("o_orderkey").alias("id"), F.explode(notices.readings(F.col("page"))).alias("r"))
    return rows.select("id", "r.field", "r.value", "r.confidence")


def fact_mentions(spark, sf_dir):
    """Sentences over suppliers: the firms, departments, governments and amounts that they state."""
    x = Ledger(spark, sf_dir)
    s = x.raw("supplier").join(F.broadcast(x.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    letter = F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij")
    firm = F.concat(F.lit("Firm "), F.initcap(letter))
    sentence = F.concat(F.lit("The PWD Public Works Department paid ₹ "), F.col("s_suppkey"), F.lit(" lakh to M/s. "), firm, F.lit(" and others, said the Government of Goa"))
    rows = s.select("s_suppkey", sentence.alias("t"))
    return rows.select("s_suppkey", F.try_element_at(facts.contractors(F.col("t")), F.lit(1)).alias("firm"), F.array_join(facts.bodies(F.col("t")), "; ").alias("bodies"), F.try_element_at(facts.amounts(F.col("t"), F.col("t")), F.lit(1))["paise"].alias("paise"), F.size(facts.officers(F.col("t"))).alias("officers"))


def places_named(spark, sf_dir):
    """Sentences that name places, longer names first: 'Nagar Haveli' claims its words before 'Nagar' can."""
    x = Ledger(spark, sf_dir)
    two = F.when(F.col("c_custkey") % 3 == 0, "NAGAR HAVELI").when(F.col("c_custkey") % 3 == 1, "Nagar").otherwise("Nagarpur")
    pages = x.raw("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Work near "), two, F.lit(", and more. Also in Nagar and "), F.initcap("c_mktsegment"), F.lit(" town.")).alias("text"))
    names = spark.createDataFrame([("Nagar", "district"), ("Nagar Haveli", "district"), ("Nagar", "sub_district"), ("Building", "sub_district"), ("Machinery", "sub_district"), ("Machinery", "sub_district")], "name string, level string")
    return gazetteer.places_in(pages, gazetteer.unambiguous(names)).select("id", "value", "sentence", F.col("confidence").cast("decimal(4,3)").alias("confidence"))


def robots_decisions(spark, sf_dir):
    """Which page addresses each host's policy lets a collector fetch; policies are derived by the host's last letter before its domain."""
    p = Ledger(spark, sf_dir).raw("pages")
    host, path = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^#]*)?", 1)
    urls = p.select("page_id", host.alias("site"), F.when(path == "", "/").otherwise(path).alias("path"))
    n = F.length("site") % 4
    body = F.when(n == 0, "User-agent: *\nDisallow: /en/\nAllow: /en/1").when(n == 1, "User-agent: other\nDisallow: /\n\nUser-agent: led\nUser-agent: *\nDisallow: *page=2 # paging\nDisallow: /fr/*$").otherwise("")
    policies = urls.select("site").distinct().select("site", F.when(n == 2, 404).when(n == 3, 503).otherwise(200).alias("status"), F.lit("text/plain").alias("content_type"), body.alias("body"))
    decided = robots.may_fetch(urls.select("site", "path").distinct(), policies, "ledgerloom")
    return decided


def page_links_office(spark, sf_dir):
    """Offices of tender chains, and their amounts' evidence windows."""
    t = Ledger(spark, sf_dir).tender
    chain = F.concat(F.col("department"), F.lit("||  ||Circle "), F.col("portal_code"), F.lit(" || "))
    window = text.context_around(F.concat(F.lit("x "), F.col("title")), F.lit(2), F.lit(8))
    return t.groupBy(text.office_of(chain).alias("office"), F.size(text.chain_segments(chain)).alias("segments")).agg(F.count("*").alias("tenders"), F.max(F.length(window)).alias("longest"))


QUERIES = [notice_fields, letter_fields, fact_mentions, places_named, robots_decisions, page_links_office]

SQL = {
    "notice_fields": with_tables(r""", v AS (SELECT id, title, 'p' AS x, '2026_' || upper(portal_code) || '_' || id || '_1' AS tid, CAST(tender_value_paise AS VARCHAR) AS paise, strftime(first_seen_at, '%Y-%m-%d') AS d FROM tender)
SELECT id, 'gepnic_tender_id' AS field, 'tender_identifier' AS kind, tid AS value, CAST(0.9 AS DECIMAL(4,3)) AS confidence FROM v UNION ALL SELECT id, 'tender_reference_number', 'tender_identifier', title, 0.9 FROM v UNION ALL SELECT id, 'tender_value', 'monetary_amount', paise, 0.9 FROM v
UNION ALL SELECT id, 'publish', 'tender_date', d || 'T00:00:00.000000Z', 0.9 FROM v UNION ALL SELECT id, 'financial_bid_opening', 'tender_date', d || 'T06:30:00.000000Z', 0.9 FROM v""", "tender"),
    "letter_fields": """WITH o AS (SELECT o_orderkey AS id, *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT id, 'emd' AS field, CAST(CAST(floor(o_totalprice) AS BIGINT) * 100 AS VARCHAR) AS value, CAST(0.8 AS DECIMAL(4,3)) AS confidence FROM o
UNION ALL SELECT id, 'pre_bid_meeting', CASE WHEN id % 3 = 1 THEN d || 'T12:30+05:30' ELSE d END, CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) != month(o_orderdate) THEN 0.7 ELSE 0.8 END FROM o
UNION ALL SELECT id, 'notice_number', (id % 100) || CASE WHEN id % 2 = 0 THEN ' (2026-2027)' ELSE ' (2023-24)' END, 0.8 FROM o
UNION ALL SELECT id, 'issuer_reference', 'MSIDC/Mumbai/' || o_custkey || '/2026' || CASE WHEN id % 5 = 0 THEN '(2ndCall)' ELSE '' END, 0.8 FROM o""",
    "fact_mentions": "SELECT s_suppkey, CASE WHEN length(l) > 1 THEN 'Firm ' || upper(left(l, 1)) || substr(l, 2) END AS firm, 'Public Works Department; Government of Goa' AS bodies, CAST(s_suppkey AS DECIMAL(38,0)) * 10000000 AS paise, 0 AS officers FROM (SELECT s_suppkey, translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "places_named": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Nagar Haveli district' ELSE 'Nagar district' END AS value, 0 AS sentence, CAST(0.8 AS DECIMAL(4,3)) AS confidence FROM customer WHERE c_custkey % 3 != 2
UNION ALL SELECT c_custkey, 'Nagar district', 1, 0.8 FROM customer WHERE c_custkey % 3 != 1 UNION ALL SELECT c_custkey, 'Building taluka', 1, 0.7 FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "robots_decisions": r"""WITH u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+(/[^#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+(/[^#]*)?', 1) END AS path FROM pages)
SELECT site, path, CASE length(site) % 4 WHEN 0 THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1') WHEN 1 THEN NOT (contains(path, 'page=2') OR starts_with(path, '/fr/')) WHEN 2 THEN true ELSE false END AS allowed FROM u""",
    "page_links_office": with_tables("SELECT 'Circle ' || portal_code AS office, 2 AS segments, count(*) AS tenders, max(length('x ' || title)) AS longest FROM tender GROUP BY 1", "tender"),
}
