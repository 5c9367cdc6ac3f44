"""Queries over places and bodies that facts name, over reviews of facts and over their promotion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, reviews
from ledgerloom.sources.ledger import Ledger, with_tables

# Sources whose terms or grants permit republication.
SHOWN_SOURCES = ("src0", "src1", "src4")
ENGINES = ("engine0", "engine1", "engine2")
FIRST_ID = 5_000_000


def _mentions(x: Ledger):
    """Lines as facts that name a body (the supplier) of a district; reviewed ones, not from a scan, of a permitting source."""
    lines = x.raw("lineitem").where("l_returnflag IN ('A', 'R') AND l_linenumber < 7")
    facts = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.col("l_suppkey").alias("body_id"), F.year("l_shipdate").alias("version"))
    bodies = x.raw("supplier").select(F.col("s_suppkey").alias("body_id"), F.col("s_name").alias("body_name"), (F.col("s_nationkey") + 1000).cast("long").alias("unit_id"), (F.col("s_suppkey") % 100 + 1940).alias("body_version"))
    documents = x.raw("orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("src"), (F.col("o_custkey") % 7).cast("string")).alias("source_id"))
    return facts.join(bodies, "body_id").join(documents.where(F.col("source_id").isin(*SHOWN_SOURCES)), "document_id")


def mentioned_places(spark, sf_dir):
    """Districts of state 3 that shown facts name, with a point to draw, the pages and the distinct reports; by name."""
    x = Ledger(spark, sf_dir)
    inside = hierarchy.within(x.districts, x.states.where("id = 3"), 1)
    points = x.raw("nation").where("n_nationkey % 5 != 0").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_nationkey") * 2.5).cast("double").alias("lon"), (F.col("n_nationkey") + 0.5).cast("double").alias("lat"))
    places = x.districts.join(inside, "id", "left_semi").join(points, "id").select(F.col("id").alias("unit_id"), F.col("name_en").alias("name"), "level", "lon", "lat")
    pages = _mentions(x).groupBy("unit_id", "document_id").agg(F.count("*").alias("n")).groupBy("unit_id").agg(F.sum("n").alias("pages"), F.count("*").alias("reports"))
    return places.join(pages, "unit_id").orderBy("name")


def mentions_by_report(spark, sf_dir):
    """The reports that name district 1007, each with its pages in order and the facts on them."""
    shown = _mentions(Ledger(spark, sf_dir)).where("unit_id = 1007")
    pages = F.sort_array(F.collect_list(F.struct("page_number", "fact_id")))
    text = lambda c: F.array_join(F.transform("pages", lambda p: p[c].cast("string")), ",")
    return shown.groupBy("document_id", "source_id").agg(pages.alias("pages")).select("document_id", "source_id", text("page_number").alias("page_numbers"), text("fact_id").alias("facts"))


def body_refs(spark, sf_dir):
    """Bodies with a shown mention: distinct reports, and the newest version of the body and its mentions."""
    each = _mentions(Ledger(spark, sf_dir)).groupBy("body_id", "body_name", "unit_id", "body_version", "document_id").agg(F.max("version").alias("version"))
    refs = each.groupBy("body_id", "body_name", "unit_id", "body_version").agg(F.count("*").alias("reports"), F.max("version").alias("newest"))
    return refs.select("body_id", "body_name", "unit_id", "reports", F.greatest("body_version", "newest").cast("long").alias("dataset_version"))


def pages_awaiting(spark, sf_dir):
    """Pages that some engine has not read, and which ones."""
    lines = Ledger(spark, sf_dir).raw("lineitem").select(F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.concat(F.lit("engine"), (F.col("l_suppkey") % 3).cast("string")).alias("engine"), F.when(F.col("l_returnflag") == "R", "unreadable").alias("refusal"))
    awaiting = reviews.pages_awaiting(lines.select("document_id", "page_number").distinct(), lines, list(ENGINES))
    return awaiting.select("document_id", "page_number", F.array_join("awaited", ",").alias("awaited"))


def review_outcomes(spark, sf_dir):
    """Events as submitted decisions: which were recorded or revised, and why the others were not."""
    e = Ledger(spark, sf_dir).raw("events")
    decision = F.element_at(F.array(F.lit("verified"), F.lit("corrected"), F.lit("rejected")), (F.floor(F.col("event_id") / 3) % 3 + 1).cast("int"))
    reviewer = F.when(F.col("event_id") % 11 == 0, " Me ").when(F.col("event_id") % 23 == 0, "me").otherwise("reviewer of records")
    submitted = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("fact_id"), F.when(F.col("event_id") % 2 == 0, "revise").otherwise("record").alias("kind"), decision.alias("decision"), reviewer.alias("reviewer"), F.col("event_id").alias("n"))
    value = F.when((F.col("decision") == "corrected") & (F.col("n") % 13 != 0) | (F.col("n") % 17 == 0), "145")
    return reviews.outcomes(submitted.withColumn("value", value).withColumn("note", F.when(F.col("n") % 7 != 0, "misread"))).select("id", "fact_id", "outcome")


def promoted_facts(spark, sf_dir):
    """Filled orders as reviewed facts in the ids of another ledger; links to facts that stay behind are dropped."""
    o = Ledger(spark, sf_dir).raw("orders").where("o_orderstatus = 'F'")
    return reviews.promoted(o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - F.col("o_custkey") % 9 - 1).alias("same_figure_as")), FIRST_ID)


def levels_held(spark, sf_dir):
    """Units that each state holds at each level, through units that are still valid (every thirteenth one ended)."""
    x = Ledger(spark, sf_dir)
    valid = x.admin_unit.where("id % 13 != 0 OR level = 'state'")
    pairs = hierarchy.closure(valid).where("depth > 0").join(x.states.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi")
    return pairs.join(valid.select(F.col("id").alias("descendant_id"), "level"), "descendant_id").groupBy(F.col("ancestor_id").alias("state_id"), "level").agg(F.count("*").alias("held"))


def office_groups(spark, sf_dir):
    """Unplaced tenders by issuing office: how many, their categories and portals by frequency."""
    rows = Ledger(spark, sf_dir).tender.where("admin_unit_id IS NULL").select(F.lower("department").alias("office"), "tender_category", "portal_code")
    listed = lambda c: reviews.by_frequency(rows, "office", c).select("office", F.array_join(f"{c}_values", ",").alias(c))
    return rows.groupBy("office").agg(F.count("*").alias("tenders")).join(listed("tender_category"), "office", "left").join(listed("portal_code"), "office", "left")


QUERIES = [mentioned_places, mentions_by_report, body_refs, pages_awaiting, review_outcomes, promoted_facts, levels_held, office_groups]

_MENTIONS = f"""WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS document_id, l_linenumber AS page_number, s_suppkey AS body_id, s_name AS body_name,
  CAST(s_nationkey + 1000 AS BIGINT) AS unit_id, year(l_shipdate) AS version, s_suppkey % 100 + 1940 AS body_version, 'src' || (o_custkey % 7) AS source_id
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag IN ('A', 'R') AND l_linenumber < 7 AND 'src' || (o_custkey % 7) IN {SHOWN_SOURCES})"""

SQL = {
    "mentioned_places": f"""{_MENTIONS} SELECT unit_id, n_name AS name, 'district' AS level, CAST(n_nationkey * 2.5 AS DOUBLE) AS lon, CAST(n_nationkey + 0.5 AS DOUBLE) AS lat, count(*) AS pages, count(DISTINCT document_id) AS reports
FROM m JOIN nation ON n_nationkey + 1000 = unit_id WHERE n_regionkey + 1 = 3 AND n_nationkey % 5 != 0 GROUP BY unit_id, n_name, n_nationkey""",
    "mentions_by_report": f"""{_MENTIONS} SELECT document_id, source_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number, fact_id) AS page_numbers, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY page_number, fact_id) AS facts FROM m WHERE unit_id = 1007 GROUP BY 1, 2""",
    "body_refs": f"{_MENTIONS} SELECT body_id, body_name, unit_id, count(DISTINCT document_id) AS reports, CAST(greatest(max(body_version), max(version)) AS BIGINT) AS dataset_version FROM m GROUP BY 1, 2, 3",
    "pages_awaiting": """WITH r AS (SELECT l_partkey AS document_id, l_linenumber AS page_number, 'engine' || (l_suppkey % 3) AS engine, l_returnflag = 'R' AS refused FROM lineitem),
a AS (SELECT DISTINCT document_id, page_number, e FROM r, (VALUES ('engine0'), ('engine1'), ('engine2')) v(e))
SELECT document_id, page_number, string_agg(e, ',' ORDER BY e) AS awaited FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = a.document_id AND r.page_number = a.page_number AND r.engine = a.e AND NOT r.refused) GROUP BY 1, 2""",
    "review_outcomes": """WITH s AS (SELECT event_id AS id, user_id AS fact_id, event_id % 2 = 0 AS revise, event_id // 3 % 3 = 1 AS correction, (event_id // 3 % 3 = 1 AND event_id % 13 != 0) OR event_id % 17 = 0 AS given FROM events),
c AS (SELECT *, CASE WHEN id % 11 = 0 OR id % 23 = 0 THEN 'no_reviewer' WHEN revise AND id % 7 = 0 THEN 'no_reason' WHEN correction AND NOT given THEN 'no_value' WHEN NOT correction AND given THEN 'value_without_correction' END AS refusal FROM s),
f AS (SELECT *, min(CASE WHEN refusal IS NULL AND NOT revise THEN id END) OVER (PARTITION BY fact_id) AS first FROM c)
SELECT id, fact_id, CASE WHEN refusal IS NOT NULL THEN refusal WHEN NOT revise AND id = first THEN 'recorded' WHEN NOT revise THEN 'already_decided' WHEN first < id THEN 'revised' ELSE 'not_decided' END AS outcome FROM f""",
    "promoted_facts": f"""WITH p AS (SELECT o_orderkey AS id, CAST({FIRST_ID} - 1 + row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - o_custkey % 9 - 1 END AS link FROM orders WHERE o_orderstatus = 'F')
SELECT p.id, p.target_id, q.target_id AS target_link, p.link IS NOT NULL AND q.target_id IS NULL AS dropped FROM p LEFT JOIN p q ON q.id = p.link""",
    "levels_held": with_tables(""", v AS (SELECT * FROM admin_unit WHERE id % 13 != 0 OR level = 'state'), d AS (SELECT * FROM v WHERE level = 'district')
SELECT parent_id AS state_id, level, count(*) AS held FROM d GROUP BY 1, 2 UNION ALL SELECT d.parent_id, v.level, count(*) FROM v JOIN d ON d.id = v.parent_id GROUP BY 1, 2""", "admin_unit"),
    "office_groups": with_tables(""", u AS (SELECT lower(department) AS office, tender_category, portal_code FROM tender WHERE admin_unit_id IS NULL),
c AS (SELECT office, string_agg(tender_category, ',' ORDER BY n DESC, tender_category) AS tender_category FROM (SELECT office, tender_category, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT office, string_agg(portal_code, ',' ORDER BY n DESC, portal_code) AS portal_code FROM (SELECT office, portal_code, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM (SELECT office, count(*) AS tenders FROM u GROUP BY 1) LEFT JOIN c USING (office) LEFT JOIN p USING (office)""", "tender"),
}
