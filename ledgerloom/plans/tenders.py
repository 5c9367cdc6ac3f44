"""Queries over tenders and the administrative tree, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy, tenders
from ledgerloom.sources.ledger import AS_OF, Ledger, as_of, with_tables

_OPEN = f"(closing_at IS NULL OR closing_at > TIMESTAMP '{AS_OF}')"


def counts_by_district(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    return tenders.counts_by_district(x.tender, x.districts, as_of()).orderBy(F.desc("tender_count"), "admin_unit_id")


def counts_by_district_in_state(spark, sf_dir):
    """Inside the subtree of state 2 and for one department: the parameters of the map."""
    x = Ledger(spark, sf_dir)
    subtree = hierarchy.within(x.districts, x.states.where("id = 3"), 1)
    return tenders.counts_by_district(x.tender, x.districts, as_of(), "1-URGENT", subtree)


def departments_open(spark, sf_dir):
    return tenders.departments(Ledger(spark, sf_dir).tender, as_of()).orderBy(F.desc("tender_count"), "department")


def list_tenders_topk(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    return tenders.listing(x.tender, x.districts, as_of(), limit=100)


def list_unplaced_topk(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    return tenders.listing(x.tender, x.districts, as_of(), limit=500, unplaced_only=True)


def open_by_state_district(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    return tenders.open_by_state_district(x.tender, x.admin_unit, as_of())


def unplaced_count(spark, sf_dir):
    return tenders.unplaced(Ledger(spark, sf_dir).tender, as_of())


def unit_closure(spark, sf_dir):
    return hierarchy.closure(Ledger(spark, sf_dir).admin_unit)


def unit_chain(spark, sf_dir):
    """The chain above sub-district 100001."""
    return hierarchy.ancestors(Ledger(spark, sf_dir).admin_unit, 100001, 3)


def units_with_state(spark, sf_dir):
    """Every unit with the code and name of its state, and how many units lie directly under it."""
    x = Ledger(spark, sf_dir)
    above = hierarchy.closure(x.admin_unit).join(F.broadcast(x.states.select(F.col("id").alias("ancestor_id"), F.col("lgd_code").alias("state_code"), F.col("name_en").alias("state_name"))), "ancestor_id")
    below = x.admin_unit.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    units = x.admin_unit.join(above.select(F.col("descendant_id").alias("id"), "state_code", "state_name"), "id", "left")
    return units.join(below.withColumnRenamed("parent_id", "id"), "id", "left").select("id", "level", "state_code", "state_name", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def coverage_nearest(spark, sf_dir):
    """The nearest coverage finding of each district at each level; findings sit on states, some on districts."""
    x = Ledger(spark, sf_dir)
    on_state = x.states.select(F.col("id").alias("admin_unit_id"), F.explode(F.array(F.lit("district"), F.lit("sub_district"))).alias("level"), F.when(F.col("id") % 2 == 0, "complete").otherwise("partial").alias("status"))
    on_district = x.districts.where("id % 4 = 0").select(F.col("id").alias("admin_unit_id"), F.lit("sub_district").alias("level"), F.lit("not_collected").alias("status"))
    places = x.states.select("id", "parent_id").unionByName(x.districts.select("id", "parent_id"))
    found = hierarchy.nearest_finding(on_state.unionByName(on_district), hierarchy.closure(places, 1))
    return found.select(F.col("descendant_id").alias("unit_id"), "level", "status", "inherited")


def descendants_per_level(spark, sf_dir):
    """How many units each state holds at each level below it."""
    x = Ledger(spark, sf_dir)
    pairs = hierarchy.closure(x.admin_unit).where("depth > 0").join(x.admin_unit.select(F.col("id").alias("descendant_id"), "level"), "descendant_id")
    return pairs.join(F.broadcast(x.states.select(F.col("id").alias("ancestor_id"))), "ancestor_id", "left_semi").groupBy(F.col("ancestor_id").alias("state_id"), "level").agg(F.count("*").alias("held"))


def overview_totals(spark, sf_dir):
    """The ledger's totals in one row: one pass a table, joined as one-row tables."""
    x = Ledger(spark, sf_dir)
    units = x.admin_unit.agg(F.count_if(F.col("level") == "state").alias("states"), F.count_if(F.col("level") == "district").alias("districts"), F.count_if(~F.col("level").isin("country", "state", "district")).alias("below_district"))
    opened = x.tender.where(tenders.still_open(as_of())).agg(F.count("*").alias("open_tenders"), F.count("admin_unit_id").alias("placed_open_tenders"))
    docs = x.document.agg(F.count("*").alias("reports"), F.count_if(F.col("verification_status").isin("verified", "corrected")).alias("published_facts"))
    portals = x.observation.where("event_type = 'purchase'").agg(F.countDistinct("portal_code").alias("tender_portals"))
    return units.crossJoin(F.broadcast(opened)).crossJoin(F.broadcast(docs)).crossJoin(F.broadcast(portals))


def holdings_by_state(spark, sf_dir):
    x = Ledger(spark, sf_dir)
    counted = x.document.groupBy("state_id").agg(F.count("*").alias("reports"), F.count_if(F.col("verification_status").isin("verified", "corrected")).alias("published_facts"))
    return counted.join(x.states, counted.state_id == x.states.id).select("lgd_code", "name_en", "reports", "published_facts").orderBy(F.length("lgd_code"), "lgd_code")


QUERIES = [counts_by_district, counts_by_district_in_state, departments_open, list_tenders_topk, list_unplaced_topk, open_by_state_district, unplaced_count, unit_closure, unit_chain, units_with_state, coverage_nearest, descendants_per_level, overview_totals, holdings_by_state]

_COUNTS = """SELECT t.admin_unit_id, count(*) AS tender_count, count(*) FILTER (WHERE district_source IN ('location_district', 'pincode', 'place_name', 'manual')) AS inferred_count,
  list_sort(array_agg(DISTINCT department)) AS departments, any_value(d.name_en) AS district_name
FROM tender t JOIN admin_unit d ON d.id = t.admin_unit_id"""
_CLOSURE = """, up AS (
  SELECT id AS descendant_id, id AS ancestor_id, parent_id AS next, 0 AS depth FROM admin_unit
  UNION ALL SELECT up.descendant_id, a.id, a.parent_id, up.depth + 1 FROM up JOIN admin_unit a ON a.id = up.next
)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _listing(where: str, limit: int) -> str:
    return f"""SELECT t.id, t.title, t.department, t.closing_at, d.name_en AS district_name, t.district_source,
  CAST(CAST(t.tender_value_paise * 0.01 AS DECIMAL(20,2)) AS VARCHAR) AS tender_value_inr
FROM (SELECT * FROM tender WHERE {_OPEN} {where} ORDER BY closing_at NULLS LAST, title, id LIMIT {limit}) t LEFT JOIN admin_unit d ON d.id = t.admin_unit_id"""


SQL = {
    "counts_by_district": with_tables(f"{_COUNTS} WHERE {_OPEN} GROUP BY t.admin_unit_id", "admin_unit", "tender"),
    "counts_by_district_in_state": with_tables(f"{_COUNTS} WHERE {_OPEN} AND department = '1-URGENT' AND d.parent_id = 3 GROUP BY t.admin_unit_id", "admin_unit", "tender"),
    "departments_open": with_tables(f"SELECT department, count(*) AS tender_count FROM tender WHERE {_OPEN} AND department IS NOT NULL GROUP BY department", "tender"),
    "list_tenders_topk": with_tables(_listing("", 100), "admin_unit", "tender"),
    "list_unplaced_topk": with_tables(_listing("AND admin_unit_id IS NULL", 200), "admin_unit", "tender"),
    "open_by_state_district": with_tables(f"SELECT s.lgd_code AS state_lgd_code, d.lgd_code AS district_lgd_code, count(*) AS open_tenders FROM tender t JOIN admin_unit d ON d.id = t.admin_unit_id AND d.level = 'district' JOIN admin_unit s ON s.id = d.parent_id AND s.level = 'state' WHERE {_OPEN} GROUP BY 1, 2", "admin_unit", "tender"),
    "unplaced_count": with_tables(f"SELECT count(*) AS unplaced FROM tender WHERE {_OPEN} AND admin_unit_id IS NULL", "tender"),
    "unit_closure": _recursive(with_tables(f"{_CLOSURE} SELECT ancestor_id, descendant_id, depth FROM up", "admin_unit")),
    "unit_chain": _recursive(with_tables(f"{_CLOSURE} SELECT a.id, a.level, a.name_en, up.depth FROM up JOIN admin_unit a ON a.id = up.ancestor_id WHERE descendant_id = 100001", "admin_unit")),
    "units_with_state": _recursive(with_tables(f"""{_CLOSURE} SELECT u.id, u.level, s.lgd_code AS state_code, s.name_en AS state_name, (SELECT count(*) FROM admin_unit c WHERE c.parent_id = u.id) AS n_children
FROM admin_unit u LEFT JOIN (SELECT descendant_id, a.lgd_code, a.name_en FROM up JOIN admin_unit a ON a.id = up.ancestor_id WHERE a.level = 'state') s ON s.descendant_id = u.id""", "admin_unit")),
    "coverage_nearest": """WITH place AS (SELECT r_regionkey + 1 AS id, NULL AS parent_id FROM region UNION ALL SELECT 1000 + n_nationkey, n_regionkey + 1 FROM nation),
g AS (SELECT r_regionkey + 1 AS id, l AS level, CASE WHEN (r_regionkey + 1) % 2 = 0 THEN 'complete' ELSE 'partial' END AS status FROM region, (VALUES ('district'), ('sub_district')) v(l)
  UNION ALL SELECT 1000 + n_nationkey, 'sub_district', 'not_collected' FROM nation WHERE (1000 + n_nationkey) % 4 = 0),
chain AS (SELECT id AS unit_id, id AS at, 0 AS depth FROM place UNION ALL SELECT id, parent_id, 1 FROM place WHERE parent_id IS NOT NULL)
SELECT CAST(unit_id AS BIGINT) AS unit_id, level, status, depth > 0 AS inherited FROM chain JOIN g ON g.id = chain.at QUALIFY row_number() OVER (PARTITION BY unit_id, level ORDER BY depth) = 1""",
    "descendants_per_level": with_tables("""SELECT state_id, level, count(*) AS held FROM (
  SELECT parent_id AS state_id, level FROM admin_unit WHERE level = 'district'
  UNION ALL SELECT d.parent_id, c.level FROM admin_unit c JOIN admin_unit d ON d.id = c.parent_id WHERE c.level = 'sub_district') GROUP BY 1, 2""", "admin_unit"),
    "overview_totals": with_tables(f"""SELECT (SELECT count(*) FROM admin_unit WHERE level = 'state') AS states, (SELECT count(*) FROM admin_unit WHERE level = 'district') AS districts,
  (SELECT count(*) FROM admin_unit WHERE level NOT IN ('country', 'state', 'district')) AS below_district,
  (SELECT count(*) FROM tender WHERE {_OPEN}) AS open_tenders, (SELECT count(*) FROM tender WHERE {_OPEN} AND admin_unit_id IS NOT NULL) AS placed_open_tenders,
  (SELECT count(*) FROM document) AS reports, (SELECT count(*) FROM document WHERE verification_status IN ('verified', 'corrected')) AS published_facts,
  (SELECT count(DISTINCT portal_code) FROM observation WHERE event_type = 'purchase') AS tender_portals""", "admin_unit", "tender", "document", "observation"),
    "holdings_by_state": with_tables("SELECT u.lgd_code, u.name_en, count(*) AS reports, count(*) FILTER (WHERE verification_status IN ('verified', 'corrected')) AS published_facts FROM document d JOIN admin_unit u ON u.id = d.state_id AND u.level = 'state' GROUP BY u.id, u.lgd_code, u.name_en", "admin_unit", "document"),
}
