"""Queries from pages to published facts: candidates with their places, promotion with parity, refreshing; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import page_facts
from ledgerloom.operators import publication
from ledgerloom.session import shared_dir
from ledgerloom.sources.ledger import Ledger


def _pages(spark, sf_dir):
    """Orders as pages, ten to a document: a sentence a line, with characters that stored text can't hold in between."""
    lines = Ledger(spark, sf_dir).raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(20,2)").cast("string").alias("p"))
    letter = F.char(F.col("l_suppkey") % 26 + 65)
    kinds = {
        0: ("had ₹ %s crore for M/s Firm %sab Works, Pune", "p", letter),
        1: ("had ₹ %s lacs of cost%s", "p", F.lit("")),
        2: ("had ₹ %s as cost%s", "l_partkey", F.lit("")),
        3: ("had Amount in ₹ %s of cost%s", "l_partkey", F.lit("")),
        4: ("had (₹ %s of the total) lakh%s", "p", F.lit("")),
        5: ("had ₹ %s thousand from Government of %sania", "p", letter),
        6: ("had Rs. %s lakh by the Executive Engineer, %sab, on time", "p", letter),
    }
    text = None
    for kind, (pattern, figure, name) in kinds.items():
        is_kind, one = F.col("l_linenumber") % 7 == kind, F.format_string(pattern, F.col(figure).cast("string"), name)
        text = F.when(is_kind, one) if text is None else text.when(is_kind, one)
    sentence = F.concat_ws(" ", F.lit("Work"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), text)
    pages = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p", sentence.alias("s")))).alias("lines"))
    caption = F.when(F.col("l_orderkey") % 5 == 0, "Table (₹ in lakh).\x01\n").otherwise("")
    content = F.concat(F.lit("\x02 "), F.array_join(F.transform("lines", lambda x: x["s"]), ".\x01\n"), F.lit(".\x1f\n"), caption, F.lit("\x03 "))
    return pages.select(F.floor(F.col("l_orderkey") / 10).alias("document_id"), (F.col("l_orderkey") % 10).cast("int").alias("page_number"), content.alias("content"))


def page_candidates(spark, sf_dir):
    """Every candidate of every page with its reading, its confidence and its place in the cleaned page."""
    return page_facts.candidates(_pages(spark, sf_dir))


def _reviewed(spark, sf_dir):
    """Customers as documents of their nation, parts as pages, orders as facts, events as the facts' history."""
    x = Ledger(spark, sf_dir)
    key = F.col("c_custkey")
    documents = x.raw("customer").select(key.alias("id"), F.md5(F.col("c_name").cast("binary")).alias("sha256"), F.when(key % 4 != 0, "district").alias("level"), F.when(key % 4 != 0, F.col("c_nationkey").cast("string")).alias("lgd_code"))
    pages = x.raw("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1000).alias("document_id"), F.col("p_size").alias("page_number"))
    order = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(order % 3 == 0, "corrected").otherwise("unverified")
    facts = x.raw("orders").select(order.alias("id"), F.col("o_custkey").alias("document_id"), F.when(order % 5 == 0, order - F.col("o_custkey") % 9 - 1).alias("same_figure_as"), status.alias("verification_status"), F.col("o_totalprice").cast("decimal(20,2)").alias("value"))
    history = x.raw("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("fact_id"), F.col("user_id").alias("reviewer_id"))
    return {"document": documents, "page": pages, "fact": facts, "history": history}, x.districts.select("id", "level", "lgd_code")


def promoted_ledger(spark, sf_dir):
    """Two promotions into an empty store, the second of what the first left: the published facts in the store's ids."""
    source, units = _reviewed(spark, sf_dir)
    store = publication.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    publication.promote(store, source | {"document": source["document"].where("id % 10 = 0")}, units)
    publication.promote(store, source, units)
    documents, pages, history = (store.table(n) for n in ("document", "page", "history"))
    documents = documents.select(F.col("id").alias("document_id"), "admin_unit_id").join(pages.groupBy("document_id").agg(F.count("*").alias("pages")), "document_id", "left")
    reviews = history.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("reviews"))
    rows = store.table("fact").join(documents, "document_id").join(reviews, "id", "left")
    return rows.select("id", "document_id", "admin_unit_id", "same_figure_as", "link_dropped", "verification_status", "value", F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"))


def refreshed_facts(spark, sf_dir):
    """Lines as the facts of reports that were read again: what came in, changed, was retired, or stays because it was reviewed."""
    lines = Ledger(spark, sf_dir).raw("lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    fact = lines.groupBy(key.alias("id")).agg(F.min("l_orderkey").alias("document_id"), F.min("l_linenumber").alias("page_number"), F.min("l_partkey").alias("part"), F.max(F.col("l_extendedprice").cast("decimal(20,2)")).alias("value"), F.max("l_returnflag").alias("flag"))
    row = fact.select("id", "document_id", "page_number", F.lit("monetary_amount").alias("kind"), F.concat(F.lit("part "), (F.col("part") % 3).cast("string")).alias("raw_text"), "value", F.when(F.col("flag") == "N", "unverified").otherwise("verified").alias("verification_status"))
    held = row.where("id % 7 != 0")
    read = row.where("document_id % 4 != 0 AND id % 11 != 0").withColumn("value", F.when(F.col("id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(20,2)"))
    return publication.refreshed(held, read, ["value", "verification_status"]).groupBy("document_id", "_action").agg(F.count("*").alias("facts"), F.sum("value").alias("value"), F.count("id").alias("with_id")).withColumnRenamed("_action", "action")


QUERIES = [page_candidates, promoted_ledger, refreshed_facts]

_STATUS = "CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderkey % 3 = 0 THEN 'corrected' ELSE 'unverified' END"

SQL = {
    "promoted_ledger": f"""WITH d AS (SELECT c_custkey AS c, CAST(row_number() OVER (ORDER BY c_custkey % 10 != 0, c_custkey) AS BIGINT) AS document_id, CASE WHEN c_custkey % 4 != 0 THEN CAST(c_nationkey + 1000 AS BIGINT) END AS admin_unit_id FROM customer),
p AS (SELECT p_partkey % 1000 AS c, count(*) AS pages FROM part GROUP BY 1),
h AS (SELECT event_id AS o, count(*) AS reviews FROM events GROUP BY 1),
f AS (SELECT o_orderkey AS o, o_custkey AS c, o_custkey % 10 = 0 AS early, CAST(row_number() OVER (ORDER BY o_custkey % 10 != 0, o_orderkey) AS BIGINT) AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - o_custkey % 9 - 1 END AS link,
  {_STATUS} AS verification_status, CAST(o_totalprice AS DECIMAL(20,2)) AS value FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT f.id, document_id, admin_unit_id, g.id AS same_figure_as, f.link IS NOT NULL AND g.id IS NULL AS link_dropped, f.verification_status, f.value, coalesce(pages, 0) AS pages, coalesce(reviews, 0) AS reviews
FROM f JOIN d USING (c) LEFT JOIN f g ON g.o = f.link AND g.early = f.early LEFT JOIN p ON p.c = f.c LEFT JOIN h ON h.o = f.o""",
    "refreshed_facts": """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS document_id, min(l_linenumber) AS page_number, 'part ' || (min(l_partkey) % 3) AS raw_text, max(CAST(l_extendedprice AS DECIMAL(20,2))) AS value, max(l_returnflag) = 'N' AS open FROM lineitem GROUP BY 1),
h AS (SELECT * FROM r WHERE id % 7 != 0), n AS (SELECT * REPLACE (CAST(CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END AS DECIMAL(20,2)) AS value) FROM r WHERE document_id % 4 != 0 AND id % 11 != 0),
b AS (SELECT coalesce(h.document_id, n.document_id) AS document_id, h.id, n.id AS rid, h.open, CASE WHEN n.id IS NULL THEN h.value ELSE n.value END AS value, h.value = n.value AS same FROM h FULL JOIN n ON h.id = n.id),
a AS (SELECT document_id, id, value, CASE WHEN document_id NOT IN (SELECT document_id FROM n) THEN 'kept' WHEN id IS NULL THEN 'inserted' WHEN rid IS NOT NULL THEN CASE WHEN same THEN 'kept' ELSE 'updated' END WHEN open THEN 'retired' ELSE 'reviewed' END AS action FROM b)
SELECT document_id, action, count(*) AS facts, sum(value) AS value, count(id) AS with_id FROM a GROUP BY 1, 2""",
    "page_candidates": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_linenumber % 7 AS k, l_partkey AS q, l_suppkey AS u, CAST(l_extendedprice AS DECIMAL(20,2)) AS p, chr(CAST(65 + l_suppkey % 26 AS INTEGER)) AS x, l_orderkey % 5 = 0 AS declares FROM lineitem),
s AS (SELECT *, 'Work ' || o || '-' || n || ' had ' || CASE k WHEN 0 THEN '₹ ' || p || ' crore for M/s Firm ' || x || 'ab Works, Pune' WHEN 1 THEN '₹ ' || p || ' lacs of cost' WHEN 2 THEN '₹ ' || q || ' as cost' WHEN 3 THEN 'Amount in ₹ ' || q || ' of cost'
  WHEN 4 THEN '(₹ ' || p || ' of the total) lakh' WHEN 5 THEN '₹ ' || p || ' thousand from Government of ' || x || 'ania' ELSE 'Rs. ' || p || ' lakh by the Executive Engineer, ' || x || 'ab, on time' END AS sentence FROM l),
-- a line's sentence begins after those before it, each with a full stop and a line break; only the page's last one keeps its stop
a AS (SELECT *, CAST(coalesce(sum(length(sentence) + 2) OVER (PARTITION BY o ORDER BY n, q, u, CAST(p AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins, CAST(p * 100 AS HUGEINT) AS hundredths,
  CASE WHEN NOT declares AND row_number() OVER (PARTITION BY o ORDER BY n DESC, q DESC, u DESC, CAST(p AS VARCHAR) DESC) = 1 THEN '.' ELSE '' END AS stop FROM s),
c AS (
  SELECT *, 'monetary_amount' AS kind, CASE k WHEN 0 THEN '₹ ' || p || ' crore' WHEN 2 THEN '₹ ' || q || ' ' WHEN 5 THEN '₹ ' || p || ' thousand' WHEN 6 THEN 'Rs. ' || p || ' lakh' ELSE '₹ ' || p || ' ' END AS printed,
    CASE k WHEN 0 THEN CAST(hundredths * 10000000 AS VARCHAR) WHEN 2 THEN CASE WHEN NOT declares THEN CAST(q * 100 AS VARCHAR) END WHEN 5 THEN CAST(hundredths * 1000 AS VARCHAR) WHEN 6 THEN CAST(hundredths * 100000 AS VARCHAR) END AS normalised_value,
    CASE WHEN k IN (0, 5, 6) THEN 0.8 WHEN k = 2 AND NOT declares THEN 0.6 ELSE 0.4 END AS confidence FROM a WHERE k != 3
  UNION ALL SELECT *, 'contractor_reference', 'M/s Firm ' || x || 'ab Works', 'Firm ' || x || 'ab Works', 0.7 FROM a WHERE k = 0
  UNION ALL SELECT *, 'officer_role_reference', 'Executive Engineer, ' || x || 'ab', 'Executive Engineer, ' || x || 'ab', 0.5 FROM a WHERE k = 6
  UNION ALL (SELECT *, 'body_reference', 'Government of ' || x || 'ania', 'Government of ' || x || 'ania', 0.5 FROM a WHERE k = 5 QUALIFY row_number() OVER (PARTITION BY o // 10, x ORDER BY o % 10, n, begins) = 1)
)
SELECT o // 10 AS document_id, CAST(o % 10 AS INTEGER) AS page_number, kind, sentence || stop AS raw_text, normalised_value, CAST(confidence AS DECIMAL(4,3)) AS confidence,
  CAST(begins + strpos(sentence, printed) - 1 AS INTEGER) AS char_start, CAST(begins + strpos(sentence, printed) - 1 + length(printed) AS INTEGER) AS char_end FROM c""",
}
