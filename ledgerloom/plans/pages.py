"""Queries over page markup: links, titles, table rows, labelled values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import markup, money, text
from ledgerloom.sources.ledger import Ledger, with_tables


def links_and_titles(spark, sf_dir):
    """Every page's distinct links with the place of the first, and a title from each address."""
    rows = markup.links(Ledger(spark, sf_dir).raw("pages"), "html", "page_id")
    return rows.select("page_id", "href", "place", text.title_from_url(F.col("href")).alias("title"))


def page_titles(spark, sf_dir):
    """The page's own title, decoded, and the one that its address suggests."""
    p = Ledger(spark, sf_dir).raw("pages")
    return p.select("page_id", markup.plain(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), text.title_from_url(F.col("url")).alias("from_url"))


def _tender_pages(spark, sf_dir):
    """Each tender printed as a detail page whose last row is never closed."""
    t = Ledger(spark, sf_dir).tender
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    value = (F.col("tender_value_paise") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").cast("string")
    row = lambda k, v: F.concat(F.lit("<tr>"), cell(F.lit(k)), cell(v), F.lit("</tr>"))
    page = F.concat(F.lit("<table>"), row("Tender Title", F.col("title")), row("Department", F.concat(F.lit("&lt;"), F.col("department"), F.lit("&gt;"))), row("Tender Title", F.lit("a later one")), row("EMD", F.lit("NA")), row("Tender Value in &#8377;", value), F.lit("<tr><td>Category<td>"), F.col("tender_category"))
    return t.select("id", page.alias("html"))


def detail_fields(spark, sf_dir):
    """Fields read back from detail pages: first label wins, NA states nothing, amounts are exact paise."""
    rows = _tender_pages(spark, sf_dir).withColumn("f", markup.stated_fields(F.col("html")))
    value = markup.first_of(F.col("f"), "Tender Value in ₹", "Tender Value")
    return rows.select("id", markup.first_of(F.col("f"), "Tender Title").alias("title"), markup.first_of(F.col("f"), "Department").alias("department"), markup.first_of(F.col("f"), "EMD").alias("emd"), money.rupees_to_paise(value).alias("paise"), F.size("f").alias("fields"))


def broken_rows(spark, sf_dir):
    """Rows and cells by opening tags alone: also those that are never closed."""
    rows = _tender_pages(spark, sf_dir).withColumn("r", markup.rows_by_split(F.col("html")))
    return rows.select("id", F.size("r").alias("rows"), F.try_element_at(F.element_at("r", -1), F.lit(2)).alias("category"))


def listing_rows(spark, sf_dir):
    """Items of page menus with their labels, as (page, label) counts: listing rows that repeat across pages."""
    p = Ledger(spark, sf_dir).raw("pages")
    items = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<li>(.*?)</li>"), F.lit(1))).alias("item"))
    return items.select("page_id", markup.plain(F.col("item")).alias("label")).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")).where("n > 1")


QUERIES = [links_and_titles, page_titles, detail_fields, broken_rows, listing_rows]

_DECODED = "replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_PLAIN = "trim(regexp_replace(" + _DECODED.format("regexp_replace({0}, '<[^>]*>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


def _title(url: str) -> str:
    last = f"string_split(regexp_replace({url}, '[?#].*$', ''), '/')[-1]"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({last}, '\\.[A-Za-z0-9]{{1,5}}$', ''), '-[0-9a-f]{{8,}}$', ''), '[_-]+', ' ', 'g'))"


SQL = {
    "links_and_titles": f"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS l FROM pages), e AS (SELECT page_id, {_DECODED.format("l[i]")} AS href, i - 1 AS place FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM h))
SELECT page_id, href, CAST(min(place) AS INTEGER) AS place, {_title("href")} AS title FROM e GROUP BY page_id, href""",
    "page_titles": f"SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title, {_title('url')} AS from_url FROM pages",
    "detail_fields": with_tables("SELECT id, title, '<' || department || '>' AS department, CAST(NULL AS VARCHAR) AS emd, tender_value_paise AS paise, 3 AS fields FROM tender", "tender"),
    "broken_rows": with_tables("SELECT id, 6 AS rows, tender_category AS category FROM tender", "tender"),
    "listing_rows": f"SELECT label, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, {_PLAIN.format('item')} AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)) AS item FROM pages)) GROUP BY label HAVING count(*) > 1",
}
