"""Queries over listing pages made of the given tables: rows of readable pages, refusals, a directory, and what a run collects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import listings
from ledgerloom.sources.ledger import Ledger

ORIGIN = "https://listing.example"


def _cells(*cells):
    return F.concat(*[part for name, text in cells for part in (F.lit(f'<td class="views-field {listings.CLASS_PREFIX}{name}">'), text, F.lit("</td>"))])


def _joined(rows, key, order):
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "row"))), lambda r: r["row"]), "").alias("body"))


def _class_pages(x: Ledger):
    """A page of each customer's orders, with columns by class in another order for every second page; some are not the table."""
    key, page = F.col("o_orderkey"), F.col("o_custkey")
    name = listings.CLASS_COLUMNS
    day = F.date_format("o_orderdate", "d MMMM yyyy")
    dated = (name["published"], F.when(key % 7 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(day))
    link = F.concat(F.lit(f'<a href="/notices/'), (key % 1000).cast("string"), F.lit('.pdf">one</a><a href="/notices/'), (key % 1000).cast("string"), F.lit('.pdf">again</a><a href="'), F.lit(f"{ORIGIN}/x/"), key.cast("string"), F.lit('.PDF?v=1">two</a><a href="/page.html">no</a>'))
    titled = (name["title"], F.concat(F.lit("<!-- theme -->Works  &amp; <b>"), "o_orderpriority", F.lit("</b>"), link))
    others = [(name["reference"], F.concat(F.lit("R/"), key.cast("string"))), (name["board"], F.col("o_orderstatus")), (name["closing"], F.lit("31 September 2026"))]
    row = F.concat(F.lit("<tr>"), F.when(page % 2 == 0, _cells(dated, titled, *others)).otherwise(_cells(*others, titled, dated)), F.lit("</tr>"))
    bodies = _joined(x.raw("orders").select("o_custkey", "o_orderkey", row.alias("row")), "o_custkey", "o_orderkey")
    heads = [F.lit("".join(f'<th class="views-field {listings.CLASS_PREFIX}{name[n]}">{n}</th>' for n in listings.CLASS_NEEDED if n != "board")), F.when(page % 13 == 0, "").otherwise(f'<th class="{listings.CLASS_PREFIX}{name["board"]}">board</th>')]
    table = F.concat(F.lit('<ul><li><table><tr><td>menu</td></tr></table></ul><table class="'), F.when(page % 17 == 0, "cols").otherwise(f"cols {listings.CLASS_TABLE}"), F.lit('"><thead><tr>'), *heads, F.lit("</tr></thead><tbody>"), F.when(page % 19 == 0, "").otherwise(F.col("body")), F.lit("</tbody></table>"))
    pager = F.when(page % 3 == 0, "").otherwise(F.concat(F.lit('<a href="?page=2">2</a><a href="?a=1&amp;page='), (page % 50).cast("string"), F.lit('">last</a>')))
    return bodies.select(page.alias("page_id"), F.concat(table, pager).alias("html"))


def _ordered_pages(x: Ledger):
    """A page of each order's lines as a listing with a fixed order of columns; some have another order."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    cells = [number.cast("string"), F.date_format("l_shipdate", "d MMMM-yyyy 'at 12:00 PM'"), F.when(number % 3 == 0, F.lit("08-03-2023")).otherwise(F.lit("20-Jun-1995 at 3.00 PM")), F.concat(F.lit("Work\n of "), "l_returnflag"), F.concat(F.lit('<a href=" https://docs.example/'), F.col("l_partkey").cast("string"), F.lit('.pdf">n</a><a href="<u>https://docs.example/a.pdf</u>">bad</a>'))]
    row = F.concat(F.lit("<tr>"), *[part for c in cells for part in (F.lit("<td>"), c)], F.lit("<tr><td>note"))
    bodies = _joined(x.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", row.alias("row")), "l_orderkey", F.struct("l_linenumber", "l_partkey"))
    first, second = F.when(key % 23 == 0, "Publication Date").otherwise("Sr. No"), F.when(key % 23 == 0, "Sr. No").otherwise("Publication  Date")
    head = F.concat(F.lit(f'<table class="{listings.ORDERED_TABLE} x"><tr><th>'), first, F.lit("<th>"), second, F.lit("<th>Last Date/ Time of Submission<th>Name of Work<th>Tender Notice"))
    return bodies.select(key.alias("page_id"), F.concat(head, "body", F.lit("</table>")).alias("html"))


def _directory_pages(x: Ledger):
    """A page of fifty customers each as units of a directory; some name a column otherwise, list a unit twice or give no kind."""
    key = F.col("c_custkey")
    page = F.floor(key / 50).cast("long").alias("page_id")
    local = F.when(key % 3 == 0, F.lit("ASSAM")).when(key % 3 == 1, F.concat(F.lit("ढ़ "), F.col("c_nationkey").cast("string"))).otherwise(" ")
    code = F.when(key % 1000 == 520, "x").otherwise(key.cast("string"))
    cells = [key.cast("string"), code, F.col("c_name"), local, F.when(key % 600 == 70, "Region").when(key % 2 == 0, "State").otherwise("ut"), F.when(key % 5 == 0, "na").otherwise(key.cast("string")), F.lit("-")]
    row = F.concat(F.lit("<tr>"), *[part for c in cells for part in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    bodies = _joined(x.raw("customer").select(page, key, F.when(key % 800 == 10, F.concat(row, row)).otherwise(row).alias("row")), "page_id", "c_custkey")
    head = F.concat(F.lit("<table><tr><th>S.No.</th><th>"), F.when(F.col("page_id") % 11 == 5, "LGD Code").otherwise("State LGD Code"), F.lit("</th>"), *[F.lit(f"<th>{h}</th>") for h in listings.DIRECTORY_HEADERS[1:]], F.lit("</tr>"))
    return bodies.select("page_id", F.concat(head, "body", F.lit("</table>")).alias("html"))


def listed_by_class(spark, sf_dir):
    """Rows of every readable page whose columns are told by class."""
    rows = listings.rows(listings.by_class(_class_pages(Ledger(spark, sf_dir)), ORIGIN))
    return rows.select("page_id", "place", "last_page", "title", "reference", "board", "published", listings.full_date(F.col("published")).alias("published_on"), listings.full_date(F.col("closing")).alias("closing_on"), F.array_join("documents", " ").alias("documents"))


def listed_by_headers(spark, sf_dir):
    """Rows of every readable page whose columns are told by their exact order, and whether the deadline precedes publication."""
    rows = listings.rows(listings.by_headers(_ordered_pages(Ledger(spark, sf_dir))))
    rows = rows.select("page_id", "serial", "title", listings.leading_date(F.col("published")).alias("published_on"), listings.leading_date(F.col("closing")).alias("closing_on"), F.array_join("documents", " ").alias("documents"))
    return rows.withColumn("deadline_first", F.col("closing_on") < F.col("published_on"))


def directory_units(spark, sf_dir):
    """Units of every readable directory page."""
    return listings.rows(listings.directory(_directory_pages(Ledger(spark, sf_dir)))).drop("place")


def listing_refusals(spark, sf_dir):
    """Pages that none of the three readers takes, by reader and reason."""
    x = Ledger(spark, sf_dir)
    each = {"by_class": listings.by_class(_class_pages(x), ORIGIN, whole=False), "by_headers": listings.by_headers(_ordered_pages(x), whole=False), "directory": listings.directory(_directory_pages(x))}
    first, *rest = [listings.refusals(read).select(F.lit(name).alias("reader"), "page_id", "refusal") for name, read in each.items()]
    return first.unionByName(rest[0]).unionByName(rest[1])


def collected_listing(spark, sf_dir):
    """A run over each customer's listing, a page a year: documents are lines, shared by year; every third part is held."""
    x = Ledger(spark, sf_dir)
    url = F.concat(F.lit("d/"), (F.col("l_partkey") % 97).cast("string"))
    lines = x.raw("lineitem").join(x.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("agency"), F.year("o_orderdate").alias("page"), url.alias("url"))
    held = x.raw("part").where("p_partkey % 97 % 3 = 0").select(F.concat(F.lit("d/"), (F.col("p_partkey") % 97).cast("string")).alias("url"))
    return listings.collect(lines, held)


QUERIES = [listed_by_class, listed_by_headers, directory_units, listing_refusals, collected_listing]

_CLASS = "CASE WHEN o_custkey % 17 = 0 THEN 'no_table' WHEN o_custkey % 13 = 0 THEN 'missing_columns' WHEN o_custkey % 19 = 0 THEN 'no_rows' END"
_ORDERED = "CASE WHEN l_orderkey % 23 = 0 THEN 'unexpected_columns' END"
_DIRECTORY = """WITH d AS (SELECT *, c_custkey // 50 AS page_id FROM customer),
p AS (SELECT page_id, CASE WHEN page_id % 11 = 5 THEN 'missing_columns' WHEN bool_or(c_custkey % 1000 = 520) THEN 'code_not_numeric' WHEN bool_or(c_custkey % 600 = 70) THEN 'kind_unknown' WHEN bool_or(c_custkey % 800 = 10) THEN 'code_twice' END AS refusal FROM d GROUP BY 1)"""

SQL = {
    "listed_by_class": f"""SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, CASE WHEN o_custkey % 3 != 0 THEN CAST(greatest(2, o_custkey % 50) AS INTEGER) END AS last_page,
  'Works & ' || o_orderpriority || 'oneagaintwono' AS title, 'R/' || o_orderkey AS reference, o_orderstatus AS board, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%-d %B %Y') END AS published,
  CASE WHEN o_orderkey % 7 != 0 THEN CAST(o_orderdate AS DATE) END AS published_on, CAST(NULL AS DATE) AS closing_on, '{ORIGIN}/notices/' || (o_orderkey % 1000) || '.pdf {ORIGIN}/x/' || o_orderkey || '.PDF?v=1' AS documents
FROM orders WHERE ({_CLASS}) IS NULL""",
    "listed_by_headers": f"""SELECT *, closing_on < published_on AS deadline_first FROM (SELECT l_orderkey AS page_id, CAST(l_linenumber AS VARCHAR) AS serial, 'Work of ' || l_returnflag AS title, CAST(l_shipdate AS DATE) AS published_on,
  CASE WHEN l_linenumber % 3 != 0 THEN DATE '1995-06-20' END AS closing_on, 'https://docs.example/' || l_partkey || '.pdf' AS documents FROM lineitem WHERE ({_ORDERED}) IS NULL)""",
    "directory_units": f"""{_DIRECTORY} SELECT page_id, CAST(c_custkey AS VARCHAR) AS code, c_name AS name_en, CASE WHEN c_custkey % 3 = 1 THEN chr(2338) || chr(2364) || ' ' || c_nationkey END AS name_local,
  CASE WHEN c_custkey % 2 = 0 THEN 'STATE' ELSE 'UT' END AS kind, CASE WHEN c_custkey % 5 != 0 THEN CAST(c_custkey AS VARCHAR) END AS census_2001, CAST(NULL AS VARCHAR) AS census_2011 FROM d JOIN p USING (page_id) WHERE refusal IS NULL""",
    "listing_refusals": f"""{_DIRECTORY} SELECT DISTINCT 'by_class' AS reader, o_custkey AS page_id, {_CLASS} AS refusal FROM orders WHERE ({_CLASS}) IS NOT NULL
UNION ALL SELECT DISTINCT 'by_headers', l_orderkey, {_ORDERED} FROM lineitem WHERE ({_ORDERED}) IS NOT NULL UNION ALL SELECT 'directory', page_id, refusal FROM p WHERE refusal IS NOT NULL""",
    "collected_listing": """WITH l AS (SELECT o_custkey AS agency, CAST(year(o_orderdate) AS INTEGER) AS page, l_partkey % 97 AS url FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT DISTINCT p_partkey % 97 AS url FROM part WHERE p_partkey % 97 % 3 = 0),
n AS (SELECT agency, page, count(*) AS listed, count(DISTINCT url) FILTER (WHERE url NOT IN (SELECT url FROM h) AND NOT EXISTS (SELECT 1 FROM l e WHERE e.agency = l.agency AND e.url = l.url AND e.page < l.page)) AS fetched FROM l GROUP BY 1, 2),
s AS (SELECT agency, min(page) FILTER (WHERE fetched = 0) AS stop FROM n GROUP BY 1)
SELECT agency, count(*) AS pages, CAST(sum(listed) AS BIGINT) AS listed, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(listed - fetched) AS BIGINT) AS already_held FROM n JOIN s USING (agency) WHERE stop IS NULL OR page <= stop GROUP BY 1""",
}
