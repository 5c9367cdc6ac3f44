"""Boundaries of places from map relations: parsed or refused with a reason, checked, oriented, nested, and claimed by places.

Rings are rows, so that a place with very many of them is work for many tasks. Crossings are found among the segments
that share a grid cell of a place, nesting among those that share a band of latitude; both joins are on equal keys. A
boundary whose rings cross or touch themselves is refused and named; nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rings as ways
from ledgerloom.operators.reviews import reserved

# Levels of the map's administrative numbers, registers by tag suffix, and where a boundary can lie.
LEVELS = {2: "country", 4: "state", 5: "district", 6: "sub_district", 7: "block", 8: "urban_local_body", 9: "village", 10: "ward"}
REGISTERS = {"state": "state", "district": "district", "subdistrict": "sub_district", "block": "block", "village": "village"}
WEST, SOUTH, EAST, NORTH = 67.0, 5.0, 99.0, 38.0
#: Degrees of a grid cell and of a band.
CELL = 0.25


def _looked_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def parsed(elements: DataFrame) -> DataFrame:
    """elements (type, id, tags map, members array of type, role, geometry) as units with rings, or with the reason of their refusal.

    A code of a register is kept only if the register is that of the unit's level: bare numbers of two registers look alike.
    """
    tags = F.col("tags")
    raw = F.try_element_at(tags, F.lit("admin_level"))
    number = raw.try_cast("double")
    integer = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1000)
    rows = elements.where("type = 'relation'").withColumn("name", F.trim(F.try_element_at(tags, F.lit("name")))).withColumn("_level", F.when(integer, number.cast("int")))
    rows = rows.withColumn("level", _looked_up(LEVELS, F.col("_level"))).withColumn("_made", ways.assembled("members"))
    away = F.filter(F.flatten(F.coalesce("_made.rings", F.array().cast("array<array<struct<lon:double,lat:double>>>"))), lambda p: ~F.coalesce(p["lon"].between(WEST, EAST) & p["lat"].between(SOUTH, NORTH), F.lit(False)))
    outside = F.try_element_at(away, F.lit(1))
    reference = F.try_element_at(F.filter(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))), lambda e: F.startswith(F.lower(e["key"]), F.lit("ref:lgd")) & F.trim(e["value"]).rlike("^[0-9]+$")), F.lit(1))
    register = _looked_up(REGISTERS, F.regexp_replace(F.lower(reference["key"]), "^ref:lgd:?", ""))
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "no name tag").when(F.col("_level").isNull(), F.concat(F.lit("admin_level is not an integer: "), F.coalesce(raw, F.lit("absent"))))
        .when(F.col("level").isNull(), F.concat(F.lit("admin_level "), F.col("_level").cast("string"), F.lit(" has no ledger level"))).when(F.col("_made.reason").isNotNull(), F.col("_made.reason"))
        .when(outside.isNotNull(), F.concat(F.lit("coordinate outside India: "), outside["lon"].cast("string"), F.lit(","), outside["lat"].cast("string")))
    )
    rows = rows.withColumn("reason", reason).withColumn("_own", register == F.col("level"))
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.select(F.col("id").alias("osm_relation_id"), "name", kept(F.col("level")).alias("level"), kept(F.when(F.col("_own"), F.trim(reference["value"]))).alias("lgd_code"), kept(F.col("_made.rings")).alias("rings"), "reason")


def ring_rows(units: DataFrame, key: str = "osm_relation_id") -> DataFrame:
    """(key, ring, points): a row a ring."""
    return units.select(key, F.posexplode("rings").alias("ring", "points"))


def segments(rings: DataFrame, key: str) -> DataFrame:
    """(key, ring, seq, last, ax, ay, bx, by): the sides of every ring; sides without length go."""
    sides = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    rows = rings.where(F.size("points") >= 2).select(key, "ring", (F.size("points") - 2).alias("last"), F.posexplode(sides).alias("seq", "s"))
    return rows.select(key, "ring", "seq", "last", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by")).where("ax != bx OR ay != by")


def _touched_cells(cell: float) -> Column:
    """The grid cells along a segment: for each column that it crosses, the rows that it passes there."""
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at = lambda x: F.col("ay") + (x - F.col("ax")) * slope

    def column(cx: Column) -> Column:
        y1, y2 = at(F.greatest(low, cx * cell)), at(F.least(high, (cx + 1) * cell))
        y1, y2 = F.coalesce(y1, F.col("ay")), F.coalesce(y2, F.col("by"))
        rows = F.sequence(F.floor((F.least(y1, y2) - 1e-9) / cell), F.floor((F.greatest(y1, y2) + 1e-9) / cell))
        return F.transform(rows, lambda cy: F.struct(cx.alias("x"), cy.alias("y")))

    return F.flatten(F.transform(F.sequence(F.floor(low / cell), F.floor(high / cell)), column))


def crossing(rings: DataFrame, key: str = "osm_relation_id", cell: float = CELL) -> DataFrame:
    """(key, crossings): places whose sides cross, overlap or meet anywhere but at the ends of neighbours."""
    sides = segments(rings, key).withColumn("_cell", F.explode(_touched_cells(cell)))
    a, b = sides.alias("a"), sides.alias("b")
    c = lambda n: F.col(n)
    side = lambda p, q, r: F.signum((c(f"{q}x") - c(f"{p}x")) * (c(f"{r}y") - c(f"{p}y")) - (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}x") - c(f"{p}x")))
    later = (c("a.ring") < c("b.ring")) | ((c("a.ring") == c("b.ring")) & (c("a.seq") < c("b.seq")))
    neighbours = (c("a.ring") == c("b.ring")) & ((c("b.seq") == c("a.seq") + 1) | ((c("a.seq") == 0) & (c("b.seq") == c("b.last"))))
    d1, d2, d3, d4 = side("b.a", "b.b", "a.a"), side("b.a", "b.b", "a.b"), side("a.a", "a.b", "b.a"), side("a.a", "a.b", "b.b")
    boxes = (F.greatest("a.ax", "a.bx") >= F.least("b.ax", "b.bx")) & (F.greatest("b.ax", "b.bx") >= F.least("a.ax", "a.bx")) & (F.greatest("a.ay", "a.by") >= F.least("b.ay", "b.by")) & (F.greatest("b.ay", "b.by") >= F.least("a.ay", "a.by"))
    meet = boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)
    # neighbours share a point; they overlap if both lie on one line and turn back
    back = (d1 == 0) & (d2 == 0) & ((c("a.bx") - c("a.ax")) * (c("b.bx") - c("b.ax")) + (c("a.by") - c("a.ay")) * (c("b.by") - c("b.ay")) < 0)
    hits = a.join(b, (c(f"a.{key}") == c(f"b.{key}")) & (c("a._cell") == c("b._cell")) & later & F.when(neighbours, back).otherwise(meet))
    return hits.select(c(f"a.{key}").alias(key), *(c(f"{s}.{n}").alias(f"{s}_{n}") for s in "ab" for n in ("ring", "seq"))).distinct().groupBy(key).agg(F.count("*").alias("crossings"))


def nested(rings: DataFrame, key: str = "osm_relation_id", band: float = CELL) -> DataFrame:
    """Rings that don't cross, with depth, role, the ring around each, area, and points turned: outer ones counter-clockwise, holes clockwise."""
    sides = segments(rings, key)
    area = sides.groupBy(key, "ring").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("_signed"))
    probe = sides.where("seq = 0").select(key, F.col("ring").alias("inner"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y")).withColumn("_band", F.floor(F.col("y") / band))
    spans = F.sequence(F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band))
    banded = sides.withColumn("_band", F.explode(spans)).join(probe, [key, "_band"]).where("ring != inner AND (ay > y) != (by > y)")
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    around = banded.where(right).groupBy(key, "inner", "ring").agg((F.count("*") % 2).alias("_odd")).where("_odd = 1").select(key, F.col("inner").alias("ring"), F.col("ring").alias("outer"))
    depth = around.groupBy(key, "ring").agg(F.count("*").alias("depth"))
    rows = rings.join(area, [key, "ring"]).join(depth, [key, "ring"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    parents = around.join(rows.select(key, F.col("ring").alias("outer"), F.col("depth").alias("_deep")), [key, "outer"]).groupBy(key, "ring").agg(F.max_by("outer", "_deep").alias("parent"))
    outer = F.col("depth") % 2 == 0
    turned = F.when(outer == (F.col("_signed") > 0), F.col("points")).otherwise(F.reverse("points"))
    return rows.join(parents, [key, "ring"], "left").select(key, "ring", "depth", F.when(outer, "outer").otherwise("hole").alias("role"), "parent", F.abs("_signed").alias("area"), turned.alias("points"))


def valid(units: DataFrame, key: str = "osm_relation_id") -> DataFrame:
    """Parsed units with polygons (arrays of an outer ring and its holes) and their area, or a reason: also one for crossings and for no area."""
    kept = units.where("reason IS NULL")
    rings = ring_rows(kept, key)
    bad = crossing(rings, key).withColumn("_cross", F.lit(True)).select(key, "_cross")
    fine = nested(rings.join(bad, key, "left_anti"), key)
    holes = fine.where("role = 'hole'").groupBy(key, F.col("parent").alias("ring")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "points"))), lambda h: h["points"]).alias("_holes"), F.sum("area").alias("_less"))
    outer = fine.where("role = 'outer'").join(holes, [key, "ring"], "left")
    polygon = F.concat(F.array("points"), F.coalesce("_holes", F.expr("slice(array(points), 1, 0)")))
    made = outer.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", polygon.alias("p")))), lambda x: x["p"]).alias("polygons"), F.sum(F.col("area") - F.coalesce("_less", F.lit(0.0))).alias("area"))
    rows = units.join(bad, key, "left").join(made, key, "left")
    reason = F.coalesce("reason", F.when(F.col("_cross"), "rings cross or touch themselves").when(F.coalesce("area", F.lit(0.0)) <= 0, "no area"))
    keep = lambda c: F.when(reason.isNull(), F.col(c)).alias(c)
    return rows.select(key, "name", "level", "lgd_code", keep("polygons"), keep("area"), reason.alias("reason"))


def loaded(held: DataFrame, units: DataFrame) -> DataFrame:
    """held places (id, level, lgd_code, name_en, parent_id, osm_relation_id) after a load of units (.., parent_id), with _status.

    A place without a relation is claimed by the first unit of its level and code. A unit whose relation a place has updates
    that place, but never its name, and its code only where it had none; any other one is inserted.
    """
    claims = units.where("lgd_code IS NOT NULL").groupBy("level", "lgd_code").agg(F.min("osm_relation_id").alias("_claim"))
    taken = held.where("osm_relation_id IS NOT NULL").select(F.col("osm_relation_id").alias("_claim"))
    free = claims.join(taken, "_claim", "left_anti")
    claimed = held.join(free, ["level", "lgd_code"], "left").withColumn("osm_relation_id", F.coalesce("osm_relation_id", "_claim")).drop("_claim")
    u = units.select("osm_relation_id", *(F.col(c).alias(f"_{c}") for c in ("level", "lgd_code", "name", "parent_id")), F.lit(True).alias("_read"))
    merged = claimed.where("osm_relation_id IS NOT NULL").join(u, "osm_relation_id", "full_outer")
    both = merged.where("id IS NOT NULL").unionByName(claimed.where("osm_relation_id IS NULL"), allowMissingColumns=True)
    columns = [F.col("id"), "level", F.coalesce("lgd_code", "_lgd_code").alias("lgd_code"), "name_en", F.coalesce("_parent_id", "parent_id").alias("parent_id"), "osm_relation_id", F.when(F.col("_read"), "updated").otherwise("kept").alias("_status")]
    new = merged.where("id IS NULL")
    top = held.agg(F.max("id")).first()[0] or 0
    ids = reserved(new, "osm_relation_id", top + 1)
    inserted = new.join(ids, "osm_relation_id").select(F.col("new_id").alias("id"), F.col("_level").alias("level"), F.col("_lgd_code").alias("lgd_code"), F.col("_name").alias("name_en"), F.col("_parent_id").alias("parent_id"), "osm_relation_id", F.lit("inserted").alias("_status"))
    return both.select(*columns).unionByName(inserted)



def largest(places: DataFrame, limit: int) -> DataFrame:
    """The largest places, ties by their relation."""
    return places.orderBy(F.desc("area"), "osm_relation_id").limit(limit)
