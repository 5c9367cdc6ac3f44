"""Boundaries: rings as arrays of points, measures as Column expressions, and a grid-bucketed containment join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def planar_area(ring: Column) -> Column:
    """The shoelace area of a closed ring."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    return F.abs(twice) / 2


def spherical_area(ring: Column, radius: float = 6371008.8) -> Column:
    """Square metres on a sphere of the mean earth radius."""
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.radians(e["b"]["lon"] - e["a"]["lon"]) * (2 + F.sin(F.radians(e["a"]["lat"])) + F.sin(F.radians(e["b"]["lat"]))))
    return F.abs(total) * radius * radius / 2


def centroid(ring: Column) -> Column:
    cross = lambda e: e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
    sums = F.aggregate(_edges(ring), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("a")), lambda s, e: F.struct((s["x"] + (e["a"]["lon"] + e["b"]["lon"]) * cross(e)).alias("x"), (s["y"] + (e["a"]["lat"] + e["b"]["lat"]) * cross(e)).alias("y"), (s["a"] + cross(e)).alias("a")))
    return F.struct(F.try_divide(sums["x"], 3 * sums["a"]).alias("lon"), F.try_divide(sums["y"], 3 * sums["a"]).alias("lat"))


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies inside a closed ring: an odd number of edges crosses the ray to the east."""
    crossed = F.filter(_edges(ring), lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"]))
    return F.size(crossed) % 2 == 1


def overlaps(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def cells(box: Column, size: float) -> Column:
    """The grid cells that a box touches, as (x, y) structs."""
    steps = lambda low, high: F.sequence(F.floor(low / size), F.floor(high / size))
    return F.flatten(F.transform(steps(box["west"], box["east"]), lambda x: F.transform(steps(box["south"], box["north"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def smallest_container(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """For each point (id, lon, lat, area) the smallest larger area (id, ring, area) that contains it.

    Both sides are dealt to grid cells, so the join is an equi-join: a point has one cell, an area as many as
    its box touches. The exact test runs on the pairs of a cell only.
    """
    p = points.select(F.col("id").alias("child_id"), "lon", "lat", F.col("area").alias("child_area"), F.struct(F.floor(F.col("lon") / cell).alias("x"), F.floor(F.col("lat") / cell).alias("y")).alias("_cell"))
    a = areas.select(F.col("id").alias("parent_id"), "ring", F.col("area").alias("parent_area"), F.explode(cells(bbox(F.col("ring")), cell)).alias("_cell"))
    hits = p.join(a, "_cell").where((F.col("parent_area") > F.col("child_area")) & contains(F.col("ring"), F.col("lon"), F.col("lat")))
    w = W.partitionBy("child_id").orderBy("parent_area", "parent_id")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("child_id", "parent_id", "parent_area")


def simplify(ring: Column, tolerance: float) -> Column:
    """A ring without points closer to the last kept one than the tolerance; its ends stay."""
    kept = F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0))), F.slice(ring, 1, 1), lambda acc, p: F.when(F.hypot(p["lon"] - F.element_at(acc, -1)["lon"], p["lat"] - F.element_at(acc, -1)["lat"]) >= tolerance, F.array_append(acc, p)).otherwise(acc))
    return F.array_append(kept, F.element_at(ring, -1))


def geojson(ring: Column, digits: int = 5) -> Column:
    """A polygon feature's geometry with rounded coordinates."""
    points = F.transform(ring, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates")))


def square(west: Column, south: Column, size: Column) -> Column:
    """A closed square ring."""
    corner = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    return F.array(corner(west, south), corner(west + size, south), corner(west + size, south + size), corner(west, south + size), corner(west, south))
