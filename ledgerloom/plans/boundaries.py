"""Query over boundaries of map relations: parsed, checked and nested, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import boundaries
from ledgerloom.sources.ledger import Ledger


def _elements(spark, sf_dir):
    """Suppliers as relations: squares of two ways, some with a hole, bow-ties, open, far away, or without a name."""
    s, k = Ledger(spark, sf_dir).raw("supplier"), F.col("s_suppkey")
    west, south = F.when(k % 13 == 0, 110.0).otherwise(70.0) + k % 20, 10.0 + F.floor(k / 20) % 20
    point = lambda dx, dy: F.struct((south + dy).cast("double").alias("lat"), (west + dx).cast("double").alias("lon"))
    a, b, c, d = point(0, 0), point(0.5, 0), point(0.5, 0.5), point(0, 0.5)
    way = lambda role, *ps: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), F.array(*ps).alias("geometry"))
    hole = [point(0.125, 0.125), point(0.375, 0.125), point(0.375, 0.375), point(0.125, 0.375)]
    members = (
        F.when(k % 11 == 0, F.array(way("outer", a, b, c))).when(k % 7 == 0, F.array(way("outer", a, c, b), way("outer", a, d, b)))
        .when(k % 5 == 0, F.array(way("outer", a, b, c), way("inner", *hole, hole[0]), way("outer", a, d, c))).otherwise(F.array(way("outer", a, b, c), way("outer", a, d, c)))
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("5", "6", "9", "4", "x", "3")]), (k % 6 + 1).cast("int"))
    tags = F.create_map(F.lit("name"), F.when(k % 17 == 0, " ").otherwise(F.col("s_name")), F.lit("admin_level"), level, F.when(k % 2 == 0, "ref:LGD:district").otherwise("ref:LGD:subdistrict"), k.cast("string"))
    return s.select(F.lit("relation").alias("type"), k.alias("id"), tags.alias("tags"), members.alias("members"))


def checked_boundaries(spark, sf_dir):
    """Every relation with its level, its code of the right register, its outer rings, holes and area, or why it is refused."""
    rows = boundaries.valid(boundaries.parsed(_elements(spark, sf_dir)))
    holes = F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p) - 1)
    return rows.select("osm_relation_id", "level", "lgd_code", F.coalesce(F.size("polygons"), F.lit(0)).alias("outers"), F.coalesce(holes, F.lit(0)).alias("holes"), F.round("area", 6).alias("area"), "reason")


QUERIES = [checked_boundaries]

SQL = {
    "checked_boundaries": """WITH s AS (SELECT s_suppkey AS k, ['5', '6', '9', '4', 'x', '3'][s_suppkey % 6 + 1] AS n, CASE WHEN s_suppkey % 13 = 0 THEN 110 ELSE 70 END + s_suppkey % 20 AS west, 10 + s_suppkey // 20 % 20 AS south FROM supplier),
r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'no name tag' WHEN n = 'x' THEN 'admin_level is not an integer: x' WHEN n = '3' THEN 'admin_level 3 has no ledger level' WHEN k % 11 = 0 THEN 'member ways do not close into a ring'
  WHEN k % 13 = 0 THEN 'coordinate outside India: ' || west || '.0,' || south || '.0' END AS early FROM s),
v AS (SELECT *, coalesce(early, CASE WHEN k % 7 = 0 THEN 'rings cross or touch themselves' END) AS reason, CASE n WHEN '5' THEN 'district' WHEN '6' THEN 'sub_district' WHEN '9' THEN 'village' WHEN '4' THEN 'state' END AS l FROM r)
SELECT k AS osm_relation_id, CASE WHEN early IS NULL THEN l END AS level, CASE WHEN early IS NULL AND (l = 'district' AND k % 2 = 0 OR l = 'sub_district' AND k % 2 = 1) THEN CAST(k AS VARCHAR) END AS lgd_code,
  CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS outers, CASE WHEN reason IS NULL AND k % 5 = 0 THEN 1 ELSE 0 END AS holes, CASE WHEN reason IS NULL THEN CASE WHEN k % 5 = 0 THEN 0.1875 ELSE 0.25 END END AS area, reason FROM v""",
}
