"""Queries over correction requests, corrected figures, the review queue and readings of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import corrections, hierarchy, readings
from ledgerloom.sources.ledger import Ledger

STATUSES = ("reviewing", "corrected", "no_change", "not_actionable", "applied")


def _requests(spark, sf_dir):
    """Events as decisions on the requests of users, every ninth of whom made none."""
    e = Ledger(spark, sf_dir).raw("events")
    n, one = F.col("event_id"), F.concat(F.lit("R"), F.col("user_id").cast("string"))
    requests = e.where("user_id % 9 != 0").groupBy(one.alias("reference")).agg(F.min("ts").alias("received_at"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.floor(n / 2) % 5 + 1).cast("int"))
    decisions = e.select(n.alias("seq"), one.alias("reference"), status.alias("status"), F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit("reviewer "), (n % 4).cast("string"))).alias("reviewer"), F.when(n % 3 != 0, F.concat(F.lit("note "), (n % 5).cast("string"))).alias("note"), F.col("ts").alias("at"))
    return requests, decisions


def correction_outcomes(spark, sf_dir):
    return corrections.outcomes(*_requests(spark, sf_dir)).select("seq", "reference", "outcome")


def correction_state(spark, sf_dir):
    """Every request after all decisions on it, with how many states were replaced."""
    requests, decisions = _requests(spark, sf_dir)
    replaced = corrections.history(requests, decisions).groupBy("reference").agg(F.count("*").alias("replaced"))
    rows = corrections.current(requests, decisions).join(replaced, "reference", "left")
    return rows.select("reference", "status", "decided_by", "resolution_note", F.coalesce("replaced", F.lit(0)).cast("long").alias("replaced"))


def correction_problems(spark, sf_dir):
    """Customers and their orders' sums as submitted forms: what is wrong with each."""
    c = Ledger(spark, sf_dir).raw("customer")
    k = F.col("c_custkey")
    subject = F.when(k % 5 == 0, F.concat(F.lit("fact:0"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("page:/"), F.repeat(F.lit("a"), (k % 400).cast("int")))).otherwise(F.concat(F.lit("tender:"), k.cast("string")))
    found = corrections.problems(subject, F.when(k % 7 == 0, "wrong").otherwise(" other "), F.substring("c_name", F.lit(1), (k % 20).cast("int")), F.when(k % 3 == 0, "ftp://x").when(k % 3 == 1, " https://x/y "), F.when(k % 13 == 0, "filled"))
    return c.select("c_custkey", F.array_join(found, ",").alias("problems"))


def batch_corrections(spark, sf_dir):
    """Orders as batches of corrected figures: what was taken, and the paise of what was."""
    price = F.col("l_extendedprice").cast("decimal(20,2)").cast("string")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("rupees", "lakh", "crore", "thousand")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    lines = Ledger(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("id"), F.when(F.col("l_partkey") % 23 == 0, F.concat(price, F.lit("5"))).otherwise(price).alias("amount"), unit.alias("unit"), F.when(F.col("l_partkey") % 29 != 0, "read again").alias("note"))
    return corrections.prepared(lines).groupBy("batch", "taken").agg(F.count("*").alias("corrections"), F.count("problem").alias("problems"), F.sum(F.when(F.col("taken"), F.col("paise"))).alias("paise"))


def review_queue(spark, sf_dir):
    """The first 500 undecided figures of state 2 and all below it, of a confidence of 0.5 or more."""
    x = Ledger(spark, sf_dir)
    o = x.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5000).alias("document_id"), (F.col("o_orderkey") % 40).cast("int").alias("page_number"), F.when(F.col("o_orderpriority") < "3", "monetary_amount").otherwise("contractor_reference").alias("kind"), (F.lit(100000) + F.col("o_custkey")).alias("admin_unit_id"), F.when(F.col("o_orderstatus") == "O", "unverified").otherwise("verified").alias("verification_status"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    units = hierarchy.within(x.admin_unit, x.states.where("id = 2"), 2).select(F.col("id").alias("admin_unit_id"))
    return corrections.queue(o, kind="monetary_amount", units=units, least_confidence=0.5).select("id", "document_id", "page_number")


def _log(spark, sf_dir):
    """Events as what engines answered for pages: every fourth is a refusal."""
    e, n = Ledger(spark, sf_dir).raw("events"), F.col("event_id")
    return e.select((F.col("user_id") % 50).alias("document_id"), (n % 6).cast("int").alias("page_number"), F.concat(F.lit("engine"), (F.floor(n / 3) % 3).cast("string")).alias("engine"), (F.floor(n / 5) % 2).cast("string").alias("engine_version"), F.lit("en").alias("languages"), F.lit(300).alias("dpi"), n.alias("seq"), F.when(F.floor(n / 7) % 4 == 0, F.concat(F.lit("refused "), (n % 8).cast("string"))).alias("refusal"), F.concat(F.lit("text "), n.cast("string")).alias("content"))


def standing_readings(spark, sf_dir):
    """The store after three batches, the last one first and one twice: what stands."""
    log = _log(spark, sf_dir)
    parts = [log.where(F.col("seq") % 3 == k) for k in (2, 0, 1)]
    store = readings.folded(readings.folded(readings.folded(parts[0]), parts[1]), parts[2], parts[1])
    return readings.standing(store).select("document_id", "page_number", "engine", "engine_version", "seq", "refusal", "content")


def engines_by_page(spark, sf_dir):
    rows = readings.engines_by_page(readings.folded(_log(spark, sf_dir)))
    return rows.select("document_id", "page_number", F.array_join("read_by", ",").alias("read_by"), F.array_join("refused_by", ",").alias("refused_by"))


QUERIES = [correction_outcomes, correction_state, correction_problems, batch_corrections, review_queue, standing_readings, engines_by_page]

_DECISIONS = f"""e AS (SELECT event_id AS seq, 'R' || user_id AS reference, {list(STATUSES)}[event_id // 2 % 5 + 1] AS status, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'reviewer ' || (event_id % 4) END AS reviewer, CASE WHEN event_id % 3 != 0 THEN 'note ' || (event_id % 5) END AS note, user_id % 9 != 0 AS known FROM events),
o AS (SELECT *, CASE WHEN NOT known THEN 'unknown_reference' WHEN status = 'applied' THEN 'unknown_status' WHEN trim(reviewer) = '' THEN 'no_reviewer' WHEN status != 'reviewing' AND note IS NULL THEN 'no_note' ELSE 'decided' END AS outcome FROM e)"""
_STORE = """l AS (SELECT user_id % 50 AS document_id, CAST(event_id % 6 AS INTEGER) AS page_number, 'engine' || (event_id // 3 % 3) AS engine, CAST(event_id // 5 % 2 AS VARCHAR) AS engine_version, event_id AS seq, CASE WHEN event_id // 7 % 4 = 0 THEN 'refused ' || (event_id % 8) END AS refusal, 'text ' || event_id AS content FROM events),
m AS (SELECT document_id, page_number, engine, engine_version, min(seq) AS seq FROM l WHERE refusal IS NULL GROUP BY ALL),
r AS (SELECT document_id, page_number, engine, max(seq) AS seq FROM l WHERE refusal IS NOT NULL GROUP BY ALL),
s AS (SELECT m.*, CAST(NULL AS VARCHAR) AS refusal, content FROM m JOIN l USING (seq) UNION ALL BY NAME
  SELECT r.document_id, r.page_number, r.engine, CAST(NULL AS VARCHAR) AS engine_version, r.seq, l.refusal, CAST(NULL AS VARCHAR) AS content FROM r JOIN l USING (seq) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.document_id = r.document_id AND m.page_number = r.page_number AND m.engine = r.engine AND m.seq > r.seq))"""

SQL = {
    "correction_outcomes": f"WITH {_DECISIONS} SELECT seq, reference, outcome FROM o",
    # each decided row's state is that of the last final decision and of the last note up to it
    "correction_state": f"""WITH {_DECISIONS}, d AS (SELECT * FROM o WHERE outcome = 'decided'),
a AS (SELECT *, status AS s, last_value(CASE WHEN status != 'reviewing' THEN seq END IGNORE NULLS) OVER w AS final, last_value(note IGNORE NULLS) OVER w AS n FROM d WINDOW w AS (PARTITION BY reference ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, coalesce(lag(s) OVER v, 'received') AS s0, lag(final) OVER v AS final0, lag(n) OVER v AS n0, row_number() OVER (PARTITION BY reference ORDER BY seq DESC) AS back FROM a WINDOW v AS (PARTITION BY reference ORDER BY seq)),
h AS (SELECT reference, count(*) AS replaced FROM b WHERE s0 != s OR final0 IS DISTINCT FROM final OR n0 IS DISTINCT FROM n GROUP BY 1)
SELECT q.reference, coalesce(b.s, 'received') AS status, f.reviewer AS decided_by, b.n AS resolution_note, coalesce(h.replaced, 0) AS replaced
FROM (SELECT DISTINCT reference FROM e WHERE known) q LEFT JOIN b ON b.reference = q.reference AND b.back = 1 LEFT JOIN e f ON f.seq = b.final LEFT JOIN h ON h.reference = q.reference""",
    "correction_problems": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 13 = 0 THEN 'automated' END, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 5 = 1 AND c_custkey % 400 > 300 THEN 'subject' END, CASE WHEN c_custkey % 7 = 0 THEN 'category' END,
  CASE WHEN length(trim(left(c_name, CAST(c_custkey % 20 AS INTEGER)))) < 10 THEN 'description_short' END, CASE WHEN c_custkey % 3 = 0 THEN 'evidence_url' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""",
    "batch_corrections": """WITH l AS (SELECT l_orderkey AS batch, CASE WHEN l_partkey % 29 = 0 OR l_partkey % 23 = 0 AND l_suppkey % 4 = 0 THEN 1 END AS problem,
  CAST(CAST(l_extendedprice AS DECIMAL(20,2)) * 100 AS HUGEINT) * 10 + CASE WHEN l_partkey % 23 = 0 THEN 5 ELSE 0 END AS thousandths, l_suppkey % 4 AS u FROM lineitem),
p AS (SELECT *, CASE u WHEN 0 THEN thousandths // 10 WHEN 1 THEN thousandths * 10000 WHEN 2 THEN thousandths * 1000000 ELSE thousandths * 100 END AS paise, count(problem) OVER (PARTITION BY batch) = 0 AS taken FROM l)
SELECT batch, taken, count(*) AS corrections, count(problem) AS problems, CAST(sum(CASE WHEN taken THEN paise END) AS DECIMAL(38,0)) AS paise FROM p GROUP BY 1, 2""",
    "review_queue": """SELECT o_orderkey AS id, o_orderkey % 5000 AS document_id, CAST(o_orderkey % 40 AS INTEGER) AS page_number FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey + 1 = 2 AND o_orderstatus = 'O' AND o_orderpriority < '3' AND o_orderkey % 10 >= 5 ORDER BY document_id, page_number, id LIMIT 500""",
    "standing_readings": f"WITH {_STORE} SELECT document_id, page_number, engine, engine_version, seq, refusal, content FROM s",
    "engines_by_page": f"WITH {_STORE} SELECT document_id, page_number, coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (WHERE refusal IS NULL), '') AS read_by, coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine) FILTER (WHERE refusal IS NOT NULL), '') AS refused_by FROM s GROUP BY 1, 2",
}
