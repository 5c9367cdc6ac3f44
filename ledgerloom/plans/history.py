"""Queries over change: upserts, refresh plans, version histories, intake limits, collection windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import reconcile
from ledgerloom.session import Cut
from ledgerloom.sources.ledger import AS_OF, Ledger, as_of, with_tables
from ledgerloom.streaming import windows


def upsert_tender(spark, sf_dir):
    """The tenders held (all but every 13th) merged with a later reading (odd ones: later deadlines, some dates lost, some placements lost)."""
    t = Ledger(spark, sf_dir).tender.select("id", "title", "closing_at", "department", "admin_unit_id", "district_source", "first_seen_at")
    held = t.where("id % 13 != 0").withColumn("district_source", F.when(F.col("id") % 17 == 0, "manual").otherwise(F.col("district_source")))
    read = t.where("id % 2 = 1").select(
        "id", "title", F.when(F.col("id") % 5 != 0, F.col("closing_at") + F.when(F.col("id") % 3 == 0, F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))).alias("closing_at"), "department",
        F.when(F.col("id") % 4 != 1, F.col("admin_unit_id") + 1).alias("admin_unit_id"), "district_source", (F.col("first_seen_at") + F.expr("INTERVAL 1 DAY")).alias("first_seen_at"),
    )
    return reconcile.upsert(held, read, ["id"], ["title"], ["closing_at", "department"], ["admin_unit_id", "district_source"], F.col("h.district_source") == "manual", ["first_seen_at"])


def refresh_plan(spark, sf_dir):
    """Lines of two readings of the orders, by identity (order, part, quantity) and occurrence: what would bring the held one up to date."""
    f = Ledger(spark, sf_dir).raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 1000).alias("document"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("value"), "l_returnflag", "l_linestatus")
    source = f.where("id % 7 != 0").withColumn("l_linestatus", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("l_linestatus")))
    return reconcile.refresh_plan(source, f.where("id % 5 != 0"), ["document", "part", "value"], ["l_returnflag", "l_linestatus"], F.col("l_returnflag") == "R")


def identity_occurrence(spark, sf_dir):
    """How many identities occur once, twice, ... among the lines."""
    f = Ledger(spark, sf_dir).raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", F.col("l_quantity").cast("long").alias("value"))
    return reconcile.numbered(f, ["l_suppkey", "value"], "id").groupBy(F.col("_n").cast("long").alias("occurrence")).agg(F.count("*").alias("n"))


def version_history(spark, sf_dir):
    """Superseded readings of each portal: what it stated until a later sighting stated something else."""
    o = Ledger(spark, sf_dir).observation.select("id", "portal_code", "seen_at", "event_type", (F.floor(F.col("stated_inr") / 100)).cast("long").alias("stated"))
    return reconcile.versions(o, ["portal_code"], "seen_at", ["event_type", "stated"]).select("id", "portal_code", "seen_at", "event_type", "stated", "superseded_at")


def changes_after_mark(spark, sf_dir):
    """How many superseded readings each portal has beyond a high-water mark of ids."""
    return version_history(spark, sf_dir).where("id > 1000").groupBy("portal_code").agg(F.count("*").alias("changes"))


def hourly_ceiling(spark, sf_dir):
    """Requests with those of the hour before them, and whether a ceiling of five an hour had paused the intake."""
    e = Ledger(spark, sf_dir).raw("events").select("event_id", "ts")
    return reconcile.paced(e, "ts", 5).select("event_id", "recent", "paused")


def streamed_ceiling(spark, sf_dir):
    """The events as a stream, each user's ceiling of four in a trailing day kept as state; a last row moves the watermark past all."""
    o = Ledger(spark, sf_dir).observation.select("id", "seen_at", "portal_code")
    end = o.agg(F.lit(-1).cast("long").alias("id"), (F.max("seen_at") + F.expr("INTERVAL 7 DAYS")).alias("seen_at"), F.lit(None).cast("string").alias("portal_code"))
    events = Cut(o.unionByName(end))
    stream = windows.sightings(spark, events.path, events.df.schema, files_per_batch=1_000_000)
    judged = windows.run_to_table(windows.trailing_ceiling(stream, "portal_code", most=4, hours=24), "append", f"ceiling-{uuid.uuid4().hex}")
    return judged.select("id", "portal_code", "recent", "paused")


def collection_windows(spark, sf_dir):
    """Each portal's window: first day collected, last success (a purchase), last attempt, status, and display state."""
    o = Ledger(spark, sf_dir).observation
    w = o.groupBy("portal_code").agg(F.to_date(F.min("seen_at")).alias("collecting_since"), F.max(F.when(F.col("event_type") == "purchase", F.col("seen_at"))).alias("last_success_at"), F.max("seen_at").alias("last_checked_at"))
    return w.withColumn("status", dates.collection_status(F.col("last_success_at"), F.col("last_checked_at"), as_of()))


def newest_window(spark, sf_dir):
    """For each group of portals (last digit), the one that succeeded last."""
    w = collection_windows(spark, sf_dir).withColumn("state", F.right("portal_code", F.lit(1)))
    return reconcile.first_of_each(w, ["state"], F.desc_nulls_last("last_success_at"), F.asc("portal_code")).select("state", "portal_code", "status")


def freshness(spark, sf_dir):
    """The alert table: portals by status, and whether the last sweep is overdue."""
    w = collection_windows(spark, sf_dir)
    return w.groupBy("status").agg(F.count("*").alias("portals"), F.max("last_checked_at").alias("last_tried")).withColumn("overdue", dates.overdue(F.col("last_tried"), as_of()))


def run_counts(spark, sf_dir):
    """One row that tallies the merge: seen, inserted, updated, unchanged, kept."""
    m = upsert_tender(spark, sf_dir)
    return m.agg(F.count("*").alias("seen"), *[F.count_if(F.col("_status") == s).alias(s) for s in ("inserted", "updated", "unchanged", "kept")])


def review_history(spark, sf_dir):
    """Conversations as review decisions: each turn that a later one of its conversation overturns, newest first."""
    c = Ledger(spark, sf_dir).raw("conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    return reconcile.versions(c, ["conv_id"], "turn", ["role", "size"]).select("conv_id", "turn", "role", F.col("superseded_at").alias("superseded_by"))


def held_urls(spark, sf_dir):
    """Reconciling mentions: keys to add and to delete so that the held set becomes the wanted one."""
    p = Ledger(spark, sf_dir).raw("pages").select("page_id", "url")
    return reconcile.reconcile_sets(p.where("page_id % 3 != 0").select("url"), p.where("page_id % 4 != 0").select("url"), ["url"])


QUERIES = [upsert_tender, refresh_plan, identity_occurrence, version_history, changes_after_mark, hourly_ceiling, streamed_ceiling, collection_windows, newest_window, freshness, run_counts, review_history, held_urls]

_STATUS = f"CASE WHEN last_success_at IS NULL OR last_checked_at > last_success_at THEN 'failing' WHEN last_success_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'stale' ELSE 'collected' END"
_WINDOWS = f", w AS (SELECT *, {_STATUS} AS status FROM (SELECT portal_code, CAST(min(seen_at) AS DATE) AS collecting_since, max(seen_at) FILTER (WHERE event_type = 'purchase') AS last_success_at, max(seen_at) AS last_checked_at FROM observation GROUP BY 1))"
_UPSERT = """, h AS (SELECT id, title, closing_at, department, admin_unit_id, CASE WHEN id % 17 = 0 THEN 'manual' ELSE district_source END AS district_source, first_seen_at FROM tender WHERE id % 13 != 0),
r AS (SELECT id, title, CASE WHEN id % 5 != 0 THEN closing_at + CASE WHEN id % 3 = 0 THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END END AS closing_at, department,
  CASE WHEN id % 4 != 1 THEN admin_unit_id + 1 END AS admin_unit_id, district_source, first_seen_at + INTERVAL 1 DAY AS first_seen_at FROM tender WHERE id % 2 = 1),
m AS (SELECT coalesce(r.id, h.id) AS id, CASE WHEN r.id IS NULL THEN h.title ELSE r.title END AS title, coalesce(r.closing_at, h.closing_at) AS closing_at, coalesce(r.department, h.department) AS department,
  CASE WHEN r.id IS NULL OR h.id IS NOT NULL AND (r.admin_unit_id IS NULL OR h.district_source = 'manual') THEN h.admin_unit_id ELSE r.admin_unit_id END AS admin_unit_id,
  CASE WHEN r.id IS NULL OR h.id IS NOT NULL AND (r.admin_unit_id IS NULL OR h.district_source = 'manual') THEN h.district_source ELSE r.district_source END AS district_source,
  coalesce(h.first_seen_at, r.first_seen_at) AS first_seen_at, h.id AS hid, r.id AS rid, h.title AS ht, h.closing_at AS hc, h.department AS hd, h.admin_unit_id AS ha, h.district_source AS hs
  FROM h FULL JOIN r ON h.id = r.id),
u AS (SELECT id, title, closing_at, department, admin_unit_id, district_source, first_seen_at, CASE WHEN hid IS NULL THEN 'inserted' WHEN rid IS NULL THEN 'kept'
  WHEN title IS NOT DISTINCT FROM ht AND closing_at IS NOT DISTINCT FROM hc AND department IS NOT DISTINCT FROM hd AND admin_unit_id IS NOT DISTINCT FROM ha AND district_source IS NOT DISTINCT FROM hs THEN 'unchanged' ELSE 'updated' END AS _status FROM m)"""
_VERSIONS = """, v AS (SELECT id, portal_code, seen_at, event_type, CAST(floor(stated_inr / 100) AS BIGINT) AS stated FROM observation),
n AS (SELECT *, lead(event_type) OVER w AS t, lead(stated) OVER w AS s, lead(seen_at) OVER w AS superseded_at FROM v WINDOW w AS (PARTITION BY portal_code ORDER BY seen_at)),
g AS (SELECT id, portal_code, seen_at, event_type, stated, superseded_at FROM n WHERE superseded_at IS NOT NULL AND (t IS DISTINCT FROM event_type OR s IS DISTINCT FROM stated))"""

SQL = {
    "upsert_tender": with_tables(f"{_UPSERT} SELECT * FROM u", "tender"),
    "run_counts": with_tables(f"{_UPSERT} SELECT count(*) AS seen, count(*) FILTER (WHERE _status = 'inserted') AS inserted, count(*) FILTER (WHERE _status = 'updated') AS updated, count(*) FILTER (WHERE _status = 'unchanged') AS unchanged, count(*) FILTER (WHERE _status = 'kept') AS kept FROM u", "tender"),
    "refresh_plan": """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 1000 AS document, l_partkey AS part, CAST(l_quantity AS BIGINT) AS value, l_returnflag, l_linestatus FROM lineitem),
s AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'X' ELSE l_linestatus END AS l_linestatus), CAST(row_number() OVER (PARTITION BY document, part, value ORDER BY id, l_returnflag, l_linestatus) - 1 AS INTEGER) AS n FROM f WHERE id % 7 != 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY document, part, value ORDER BY id, l_returnflag, l_linestatus) - 1 AS INTEGER) AS n FROM f WHERE id % 5 != 0)
SELECT coalesce(s.document, t.document) AS document, coalesce(s.part, t.part) AS part, coalesce(s.value, t.value) AS value, coalesce(s.n, t.n) AS occurrence, s.id AS source_id, t.id AS target_id,
  CASE WHEN t.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN CASE WHEN t.l_returnflag = 'R' THEN 'stranded' ELSE 'retire' END WHEN s.l_returnflag IS DISTINCT FROM t.l_returnflag OR s.l_linestatus IS DISTINCT FROM t.l_linestatus THEN 'update' ELSE 'keep' END AS action
FROM s FULL JOIN t ON s.document = t.document AND s.part = t.part AND s.value = t.value AND s.n = t.n""",
    "identity_occurrence": "SELECT n AS occurrence, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS BIGINT) ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS n FROM lineitem) x GROUP BY x.n",
    "version_history": with_tables(f"{_VERSIONS} SELECT * FROM g", "observation"),
    "changes_after_mark": with_tables(f"{_VERSIONS} SELECT portal_code, count(*) AS changes FROM g WHERE id > 1000 GROUP BY 1", "observation"),
    "streamed_ceiling": """SELECT event_id AS id, 'p' || user_id AS portal_code, least(n, 4) AS recent, n >= 4 AS paused FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM events)""",
    "hourly_ceiling": "SELECT event_id, recent, recent >= 5 AS paused FROM (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS recent FROM events)",
    "collection_windows": with_tables(f"{_WINDOWS} SELECT * FROM w", "observation"),
    "newest_window": with_tables(f"{_WINDOWS} SELECT right(portal_code, 1) AS state, portal_code, status FROM w QUALIFY row_number() OVER (PARTITION BY right(portal_code, 1) ORDER BY last_success_at DESC NULLS LAST, portal_code) = 1", "observation"),
    "freshness": with_tables(f"{_WINDOWS} SELECT status, count(*) AS portals, max(last_checked_at) AS last_tried, max(last_checked_at) < TIMESTAMP '{AS_OF}' - INTERVAL 26 HOUR AS overdue FROM w GROUP BY 1", "observation"),
    "review_history": "SELECT conv_id, turn, role, superseded_by FROM (SELECT conv_id, turn, role, length(text) AS size, lead(role) OVER w AS r, lead(length(text)) OVER w AS s, lead(turn) OVER w AS superseded_by FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE superseded_by IS NOT NULL AND (r IS DISTINCT FROM role OR s IS DISTINCT FROM size)",
    "held_urls": "WITH w AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 != 0), h AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 != 0) SELECT url, 'add' AS action FROM w WHERE url NOT IN (SELECT url FROM h) UNION ALL SELECT url, 'delete' FROM h WHERE url NOT IN (SELECT url FROM w)",
}
