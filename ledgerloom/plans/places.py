"""Queries over places: search, resolution to districts, boundaries, holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, state, text
from ledgerloom.operators import resolve, search, spatial
from ledgerloom.plans.history import collection_windows
from ledgerloom.sources.ledger import AS_OF, Ledger, as_of, with_tables

PLACE_TERM = "nation_2"
#: Keys of the given nations as names in letters, since district keys drop digits.
_NAME_SQL = "replace(regexp_replace(translate(n_name, '0123456789', 'bcdfghjklm'), '([b-m])', '\\1a', 'g'), '_', ' ')"


def search_places(spark, sf_dir):
    """The twenty names most like a term among states, districts and parts."""
    x = Ledger(spark, sf_dir)
    parts = x.raw("part").select((F.col("p_partkey") + 200000000).alias("id"), F.lit("village").alias("level"), F.col("p_name").alias("name_en"))
    names = x.states.select("id", "level", "name_en").unionByName(x.districts.select("id", "level", "name_en")).unionByName(parts)
    return search.places(names, PLACE_TERM, 20).select("id", "name_en", "prefix", "contains", F.round("score", 6).alias("score"))


def district_keys(spark, sf_dir):
    """Comparison keys of every unit and supplier name."""
    x = Ledger(spark, sf_dir)
    names = x.raw("nation").select(F.col("n_name").alias("name")).unionByName(x.raw("supplier").select(F.concat(F.lit("Zilla "), F.col("s_name"), F.lit(" Distt.")).alias("name"))).distinct()
    n = F.col("name")
    return names.select("name", text.district_key(n).alias("district_key"), text.strict_key(n).alias("strict_key"), text.slug(n).alias("slug"))


def _name():
    return F.replace(F.regexp_replace(F.translate("n_name", "0123456789", "bcdfghjklm"), "([b-m])", "$1a"), F.lit("_"), F.lit(" "))


def _clues(spark, sf_dir):
    """Clues from orders by their key: a named district, a location text, a pincode, or a post office."""
    x = Ledger(spark, sf_dir)
    o = x.raw("orders").join(x.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(x.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), _name().alias("n_name"))), "c_nationkey")
    k = F.col("o_orderkey") % 6
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, F.concat(F.col("n_name"), F.lit(" District"))).alias("district_name"), F.when(k == 0, "chain_unit").alias("district_source"),
        F.when(k.isin(1, 2), F.concat(F.lit("Block 4, "), F.col("n_name"), F.when(k == 2, F.lit(" / NATION ca")).otherwise(""))).alias("location"),
        F.when(k == 3, F.col("o_custkey") % 400).alias("pincode"), F.when(k == 4, F.concat(F.lit("Office "), (F.col("o_custkey") % 300).cast("string"))).alias("office"),
    )


def resolve_district(spark, sf_dir):
    """Every order placed by the first rule that names exactly one district."""
    x = Ledger(spark, sf_dir)
    clues = _clues(spark, sf_dir)
    homes = x.raw("supplier").select("s_suppkey", (F.col("s_nationkey") + 1000).cast("long").alias("district_id"))
    pincodes = homes.select((F.col("s_suppkey") % 400).alias("pincode"), "district_id")
    offices = homes.select(F.concat(F.lit("Office "), (F.col("s_suppkey") % 300).cast("string")).alias("office"), "district_id")
    districts = x.raw("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), _name().alias("name_en"))
    return resolve.resolve(clues, districts, pincodes, offices)


def _boundaries(x):
    """Squares: districts of side 10 on a grid five wide, and their states' rows of side 50 by 10 are left to containment."""
    n = x.raw("nation")
    ring = spatial.square((F.col("n_nationkey") % 5) * 10, F.floor(F.col("n_nationkey") / 5) * 10, F.lit(10))
    small = n.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), ring.alias("ring"))
    r = x.raw("region")
    big = r.select((F.col("r_regionkey") + 1).cast("long").alias("id"), spatial.square(F.lit(0) - F.col("r_regionkey"), F.lit(0) - F.col("r_regionkey"), F.lit(30) + F.col("r_regionkey") * 10).alias("ring"))
    return small.unionByName(big).withColumn("area", spatial.planar_area(F.col("ring")))


def spatial_parent(spark, sf_dir):
    """The smallest boundary around each customer's point."""
    x = Ledger(spark, sf_dir)
    points = x.raw("customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 60000 / 1000.0).alias("lon"), ((F.col("c_custkey") * 104729) % 60000 / 1000.0).alias("lat"), F.lit(0.0).alias("area"))
    return spatial.smallest_container(points, _boundaries(x), 10.0)


def boundary_measures(spark, sf_dir):
    """Box, area and centroid of each boundary, and whether its own centroid lies inside."""
    rows = _boundaries(Ledger(spark, sf_dir)).withColumn("box", spatial.bbox(F.col("ring"))).withColumn("mid", spatial.centroid(F.col("ring")))
    return rows.select("id", "area", "box.west", "box.south", "box.east", "box.north", F.round("mid.lon", 6).alias("lon"), F.round("mid.lat", 6).alias("lat"), spatial.contains(F.col("ring"), F.col("mid.lon"), F.col("mid.lat")).alias("inside"), F.size(spatial.simplify(F.col("ring"), 0.5)).alias("points"))


def holdings(spark, sf_dir):
    """What is held for each state, layer by layer, with the state of each layer and counts only where they may be shown."""
    x = Ledger(spark, sf_dir)
    states = x.states.select(F.col("id").alias("state_id"))
    d = x.districts.groupBy(F.col("parent_id").alias("state_id")).agg(F.count("*").alias("held"))
    boundary = states.join(d, "state_id", "left").select("state_id", F.lit("boundaries").alias("layer"), F.coalesce("held", F.lit(0)).alias("held"), state.level_coverage_state(F.when(F.col("held").isNull(), "not_collected").when(F.col("state_id") % 2 == 0, "complete").otherwise("partial")).alias("s"))
    audits = x.document.where("verification_status IN ('verified', 'corrected')").groupBy("state_id").agg(F.count("*").alias("held"))
    audit = states.join(audits, "state_id", "left").select("state_id", F.lit("audit_reports").alias("layer"), F.coalesce("held", F.lit(0)).alias("held"), state.data_state(F.when(F.col("held").isNull(), "not_collected").otherwise("collected"), F.lit("unknown"), F.lit("unknown")).alias("s"))
    w = collection_windows(spark, sf_dir).withColumn("state_id", (F.substring("portal_code", 2, 10).cast("long") % 5) + 1)
    worst = w.groupBy("state_id").agg(F.count("*").alias("held"), F.max(F.when(F.col("status") == "failing", 3).when(F.col("status") == "stale", 2).otherwise(1)).alias("_w"))
    tender = states.join(worst, "state_id", "left").select("state_id", F.lit("tenders").alias("layer"), F.coalesce("held", F.lit(0)).alias("held"), state.tender_collection_state(F.when(F.col("_w") == 3, "failing").when(F.col("_w") == 2, "stale").when(F.col("_w") == 1, "collected")).alias("s"))
    works = states.select("state_id", F.lit("works").alias("layer"), F.lit(0).cast("long").alias("held"), state.tender_collection_state(F.lit("not_collected")).alias("s"))
    rows = boundary.unionByName(audit).unionByName(tender).unionByName(works)
    return rows.select("state_id", "layer", state.display_state(F.col("s")).alias("display"), F.when(state.may_show_counts(F.col("s")), F.col("held")).alias("count"))


def tender_status(spark, sf_dir):
    """Tenders by status and by what the record knows of their district, and why not."""
    t = Ledger(spark, sf_dir).tender
    field = state.known(F.col("admin_unit_id"), F.col("tender_category") != "O")
    return t.groupBy(dates.tender_status(F.col("closing_at"), as_of()).alias("status"), field["state"].alias("district_state"), field["why"].alias("why")).agg(F.count("*").alias("tenders"))


QUERIES = [search_places, district_keys, resolve_district, spatial_parent, boundary_measures, holdings, tender_status]

_COLLAPSE = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i = 1 OR c != string_split({0}, '')[i - 1]), '')"
_DROP = r"regexp_replace(name, '\b(?:district|distt?|zilla|zila|jilla|jila)\b\.?', ' ', 'gi')"


def _strict(drop: str) -> str:
    return _COLLAPSE.format(f"regexp_replace(lower({drop}), '[^a-z]', '', 'g')")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w != ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SQUARES = """, n AS (SELECT CAST(1000 + n_nationkey AS BIGINT) AS id, CAST((n_nationkey % 5) * 10 AS DOUBLE) AS west, CAST((n_nationkey // 5) * 10 AS DOUBLE) AS south, 10.0::DOUBLE AS size FROM nation
  UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), -r_regionkey, -r_regionkey, 30 + r_regionkey * 10 FROM region)""".lstrip(", ")
_WINDOW_STATUS = f"CASE WHEN s IS NULL OR c > s THEN 3 WHEN s < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 2 ELSE 1 END"

SQL = {
    "search_places": f"""WITH u AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name_en FROM region UNION ALL SELECT 1000 + n_nationkey, n_name FROM nation UNION ALL SELECT 200000000 + p_partkey, p_name FROM part),
g AS (SELECT *, {_GRAMS.format("name_en")} AS a, {_GRAMS.format("'" + PLACE_TERM + "'")} AS b FROM u),
h AS (SELECT id, name_en, starts_with(lower(name_en), '{PLACE_TERM}') AS prefix, contains(lower(name_en), '{PLACE_TERM}') AS contains, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM g)
SELECT id, name_en, prefix, contains, round(score, 6) AS score FROM h WHERE contains OR score >= {search.SIMILAR} ORDER BY prefix DESC, contains DESC, score DESC, name_en, id LIMIT 20""",
    "district_keys": f"""SELECT name, regexp_replace({_strict(_DROP)}, '[aeiou]', '', 'g') AS district_key, {_strict(_DROP)} AS strict_key, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM (SELECT n_name AS name FROM nation UNION SELECT 'Zilla ' || s_name || ' Distt.' FROM supplier)""",
    "resolve_district": f"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_custkey, n_nationkey, {_NAME_SQL} AS n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT s_suppkey % 400 AS pin, min(s_nationkey) AS d FROM supplier GROUP BY 1 HAVING min(s_nationkey) = max(s_nationkey)), f AS (SELECT s_suppkey % 300 AS off, min(s_nationkey) AS d FROM supplier GROUP BY 1 HAVING min(s_nationkey) = max(s_nationkey)),
m AS (SELECT id, CASE WHEN k IN (0, 1) OR k = 2 AND n_name = 'NATION ca' THEN n_nationkey WHEN k = 3 THEN p.d WHEN k = 4 THEN f.d END AS d, CASE WHEN k = 0 THEN 'chain_unit' WHEN k = 1 OR k = 2 AND n_name = 'NATION ca' THEN 'location_district' WHEN k = 3 AND p.d IS NOT NULL THEN 'pincode' WHEN k = 4 AND f.d IS NOT NULL THEN 'place_name' END AS method,
  CASE WHEN k = 1 THEN 'Block 4, ' || n_name WHEN k = 2 AND n_name = 'NATION ca' THEN 'Block 4, NATION ca / NATION ca' WHEN k = 3 AND p.d IS NOT NULL THEN CAST(o_custkey % 400 AS VARCHAR) WHEN k = 4 AND f.d IS NOT NULL THEN 'Office ' || (o_custkey % 300) END AS evidence
  FROM c LEFT JOIN p ON k = 3 AND pin = o_custkey % 400 LEFT JOIN f ON k = 4 AND off = o_custkey % 300)
SELECT id, CAST(1000 + d AS BIGINT) AS district_id, method, CAST(CASE method WHEN 'chain_unit' THEN 0.9 WHEN 'location_district' THEN 0.7 WHEN 'pincode' THEN 0.6 WHEN 'place_name' THEN 0.4 END AS DECIMAL(4,3)) AS confidence, evidence FROM m""",
    "spatial_parent": f"""WITH {_SQUARES}, p AS (SELECT c_custkey AS child_id, (c_custkey * 7919) % 60000 / 1000.0 AS lon, (c_custkey * 104729) % 60000 / 1000.0 AS lat FROM customer)
SELECT child_id, n.id AS parent_id, size * size AS parent_area FROM p JOIN n ON lon >= west AND lon < west + size AND lat >= south AND lat < south + size QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY size, n.id) = 1""",
    "boundary_measures": f"WITH {_SQUARES} SELECT id, size * size AS area, west, south, west + size AS east, south + size AS north, west + size / 2 AS lon, south + size / 2 AS lat, true AS inside, 5 AS points FROM n",
    "holdings": with_tables(f""", s AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS state_id FROM region), d AS (SELECT CAST(n_regionkey + 1 AS BIGINT) AS state_id, count(*) AS held FROM nation GROUP BY 1),
a AS (SELECT state_id, count(*) AS held FROM document WHERE verification_status IN ('verified', 'corrected') GROUP BY 1),
w AS (SELECT portal_code, max(seen_at) FILTER (WHERE event_type = 'purchase') AS s, max(seen_at) AS c FROM observation GROUP BY 1),
v AS (SELECT CAST(substr(portal_code, 2) AS BIGINT) % 5 + 1 AS state_id, count(*) AS held, max({_WINDOW_STATUS}) AS worst FROM w GROUP BY 1)
SELECT state_id, 'boundaries' AS layer, CASE WHEN held IS NULL THEN 'not_collected' WHEN state_id % 2 = 0 THEN 'held' ELSE 'partial' END AS display, held AS count FROM s LEFT JOIN d USING (state_id)
UNION ALL SELECT state_id, 'audit_reports', CASE WHEN held IS NULL THEN 'not_collected' ELSE 'held' END, held FROM s LEFT JOIN a USING (state_id)
UNION ALL SELECT state_id, 'tenders', CASE worst WHEN 3 THEN 'failing' WHEN 2 THEN 'stale' WHEN 1 THEN 'current' ELSE 'not_collected' END, held FROM s LEFT JOIN v USING (state_id)
UNION ALL SELECT state_id, 'works', 'not_collected', NULL FROM s""", "document", "observation"),
    "tender_status": with_tables(f"SELECT CASE WHEN closing_at IS NULL THEN 'unknown' WHEN closing_at > TIMESTAMP '{AS_OF}' THEN 'open' ELSE 'closed' END AS status, CASE WHEN admin_unit_id IS NULL THEN 'missing' ELSE 'known' END AS district_state, CASE WHEN admin_unit_id IS NULL THEN CASE WHEN tender_category != 'O' THEN 'not_stated' ELSE 'detail_not_read' END END AS why, count(*) AS tenders FROM tender GROUP BY ALL", "tender"),
}
