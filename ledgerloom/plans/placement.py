"""Queries over placements after a change of directories, and over placements by hand, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import reresolve, resolve
from ledgerloom.plans.places import _NAME_SQL, _clues, _name
from ledgerloom.sources.ledger import Ledger


def _directories(x: Ledger) -> tuple[reresolve.Directories, reresolve.Directories]:
    """Suppliers as post offices, before and after a load that closes, moves and opens some, renames districts and reviews an alias."""
    s, home = x.raw("supplier"), (F.col("s_nationkey") + 1000).cast("long")
    office = F.concat(F.lit("Office "), (F.col("s_suppkey") % 300).cast("string"))
    moved = F.when(F.col("s_suppkey") % 9 == 0, (home - 1000 + 1) % 25 + 1000).otherwise(home)
    old = s.where("s_suppkey % 7 != 0").select((F.col("s_suppkey") % 400).alias("pincode"), office.alias("office"), home.alias("district_id"))
    new = s.where("s_suppkey % 8 != 0").select((F.col("s_suppkey") % 400).alias("pincode"), office.alias("office"), moved.alias("district_id"))
    n = x.raw("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1000).cast("long").alias("id"), _name().alias("name_en"))
    districts = lambda kept: n.where(kept).select("id", "name_en")
    alias = lambda kept: n.where(kept).select(text.district_key(F.col("name_en")).alias("key"), F.col("id").alias("district_id"), F.col("name_en").alias("alias"))
    before = reresolve.Directories(districts("k % 3 != 0"), old.select("pincode", "district_id"), old.select("office", "district_id"), alias("k = 3"))
    after = reresolve.Directories(districts("k % 3 != 0 OR k % 2 = 0"), new.select("pincode", "district_id"), new.select("office", "district_id"), alias("k IN (3, 9)"))
    return before, after


def placed_again(spark, sf_dir):
    """Every order's placement after the directories changed: held, decided, placed by the change, or still unplaced."""
    x = Ledger(spark, sf_dir)
    old, new = _directories(x)
    clues = _clues(spark, sf_dir)
    held = resolve.resolve(clues, old.districts, old.pincodes, old.offices, old.aliases)
    decided = x.raw("orders").where("o_orderkey % 10 = 3 AND o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    rows = reresolve.reresolved(held, clues, decided, old, new)
    return rows.withColumn("outcome", F.when(F.col("outcome") == "unmet", "unplaced").otherwise(F.col("outcome")))


def changed_directory(spark, sf_dir):
    """The keys whose answer the new load changed, by kind."""
    return reresolve.changed_keys(*_directories(Ledger(spark, sf_dir))).where("kind IN ('pincode', 'office')").select("kind", "key")


def hand_placements(spark, sf_dir):
    """Decisions on tenders in their order: the district each one gives, or why it is refused."""
    x = Ledger(spark, sf_dir)
    tenders = x.tender.select("id", "portal_code", F.concat(F.lit("t"), F.col("id").cast("string")).alias("portal_tender_id"), "admin_unit_id")
    portals = x.raw("nation").where("n_nationkey < 9").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("portal_code"), (F.col("n_nationkey") % 5).cast("string").alias("state_lgd_code"))
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    o = x.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    decisions = x.raw("lineitem").join(o, "l_orderkey").select(
        (k * 10 + line).cast("long").alias("decision_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("portal_code"), F.concat(F.lit("t"), F.when(k % 13 == 0, -k).otherwise(k).cast("string")).alias("portal_tender_id"),
        F.when((k + line) % 3 != 0, ((k + line) % 25).cast("string")).alias("lgd_code"), F.when(line % 6 == 0, " ").otherwise("A. Reviewer").alias("decided_by"), F.lit("read the notice").alias("reason"),
    )
    # a repeated line is one decision
    return reresolve.placed_by_hand(decisions.dropDuplicates(["decision_id"]), tenders, portals, x.admin_unit.where("level IN ('state', 'district')"))


QUERIES = [placed_again, changed_directory, hand_placements]

_LOADS = """a AS (SELECT s_suppkey % 400 AS pin, s_suppkey % 300 AS off, s_nationkey AS d FROM supplier WHERE s_suppkey % 7 != 0), b AS (SELECT s_suppkey % 400 AS pin, s_suppkey % 300 AS off, CASE WHEN s_suppkey % 9 = 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS d FROM supplier WHERE s_suppkey % 8 != 0),
ap AS (SELECT pin, min(d) AS d FROM a GROUP BY 1 HAVING min(d) = max(d)), ao AS (SELECT off, min(d) AS d FROM a GROUP BY 1 HAVING min(d) = max(d)), bp AS (SELECT pin, min(d) AS d FROM b GROUP BY 1 HAVING min(d) = max(d)), bo AS (SELECT off, min(d) AS d FROM b GROUP BY 1 HAVING min(d) = max(d))"""


_BEFORE, _AFTER = "n_nationkey % 3 != 0", "(n_nationkey % 3 != 0 OR n_nationkey % 2 = 0)"


def _run(name: str, known: str, aliased: str, pin: str, off: str) -> str:
    """One full run of the ladder in SQL: district, method and evidence of each order. Nation 1, NATION ca, is known to both."""
    return f"""{name} AS (SELECT id, d, CASE WHEN d IS NOT NULL THEN ['chain_unit', 'location_district', 'location_district', 'pincode', 'place_name'][k + 1] END AS method, CASE WHEN d IS NOT NULL THEN e END AS evidence FROM (SELECT id, k,
  CASE k WHEN 0 THEN CASE WHEN {known} OR {aliased} THEN n_nationkey END WHEN 1 THEN CASE WHEN {known} THEN n_nationkey END WHEN 2 THEN CASE WHEN n_nationkey = 1 OR NOT {known} THEN 1 END WHEN 3 THEN {pin}.d WHEN 4 THEN {off}.d END AS d,
  CASE k WHEN 0 THEN CASE WHEN NOT {known} THEN 'alias:' || n_name END WHEN 1 THEN 'Block 4, ' || n_name WHEN 2 THEN 'Block 4, ' || n_name || ' / NATION ca' WHEN 3 THEN CAST(o_custkey % 400 AS VARCHAR) WHEN 4 THEN 'Office ' || (o_custkey % 300) END AS e
  FROM c LEFT JOIN {pin} ON {pin}.pin = o_custkey % 400 LEFT JOIN {off} ON {off}.off = o_custkey % 300))"""


SQL = {
    "placed_again": f"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderkey % 10 = 3 AND o_custkey % 2 = 0 AS decided, o_custkey, n_nationkey, {_NAME_SQL} AS n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), {_LOADS},
{_run("x", _BEFORE, "n_nationkey = 3", "ap", "ao")}, {_run("y", _AFTER, "n_nationkey IN (3, 9)", "bp", "bo")},
r AS (SELECT c.id, x.d IS NULL AND NOT decided AS again, CASE WHEN again THEN y.d ELSE x.d END AS d, CASE WHEN again THEN y.method ELSE x.method END AS method, CASE WHEN again THEN y.evidence ELSE x.evidence END AS evidence, CASE WHEN decided THEN 'decided' WHEN x.d IS NOT NULL THEN 'held' WHEN y.d IS NOT NULL THEN 'placed' ELSE 'unplaced' END AS outcome FROM c JOIN x ON x.id = c.id JOIN y ON y.id = c.id)
SELECT id, CAST(1000 + d AS BIGINT) AS district_id, method, CAST(CASE method WHEN 'chain_unit' THEN 0.9 WHEN 'location_district' THEN 0.7 WHEN 'pincode' THEN 0.6 WHEN 'place_name' THEN 0.4 END AS DECIMAL(4,3)) AS confidence, evidence, outcome FROM r""",
    "changed_directory": f"WITH {_LOADS} SELECT 'pincode' AS kind, CAST(coalesce(ap.pin, bp.pin) AS VARCHAR) AS key FROM ap FULL JOIN bp ON ap.pin = bp.pin WHERE ap.d IS DISTINCT FROM bp.d UNION ALL SELECT 'office', 'Office ' || coalesce(ao.off, bo.off) FROM ao FULL JOIN bo ON ao.off = bo.off WHERE ao.d IS DISTINCT FROM bo.d",
    "hand_placements": """WITH d AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS decision_id, l_orderkey AS k, l_linenumber AS line, o_custkey, c_nationkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
e AS (SELECT *, (k + line) % 3 != 0 AS names, (k + line) % 25 AS code, o_custkey % 10 AS p FROM d),
f AS (SELECT *, CASE WHEN line % 6 = 0 THEN 'a decision needs the reviewer''s name and a reason' WHEN k % 13 = 0 AND k > 0 THEN 'no such tender on the portal' WHEN p = 9 THEN 'the portal has no state' WHEN names AND code % 5 != p % 5 THEN 'not a district of the tender''s state' END AS early FROM e),
g AS (SELECT *, early IS NULL AND names AS places, CASE WHEN k % 13 = 0 AND k > 0 THEN NULL ELSE k END AS tender_id, o_custkey % 7 != 0 OR coalesce(bool_or(early IS NULL AND names) OVER (PARTITION BY k ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS already, coalesce(bool_or(early IS NULL AND names) OVER (PARTITION BY k ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later FROM f)
SELECT decision_id, tender_id, CASE WHEN places THEN CAST(1000 + code AS BIGINT) END AS admin_unit_id, CASE WHEN places THEN n_name END AS district, CASE WHEN places THEN 'manual' END AS method, CAST(CASE WHEN places THEN 0.8 END AS DECIMAL(4,3)) AS confidence, CASE WHEN places THEN 'decision:' || decision_id END AS evidence, places AND NOT later AS last,
  coalesce(early, CASE WHEN NOT names AND already THEN 'already placed; decide a district, or leave it' END) AS refused FROM g LEFT JOIN nation ON n_nationkey = code""",
}
