"""Outlines of a level simplified so that neighbours still meet: every shared line is simplified once, for both sides.

Rings are cut where more than two lines meet. The pieces, arcs, are brought to one direction, so that both neighbours hold
the same one; each distinct arc is thinned by itself, with its ends fixed, and the rings are put together from the thinned
arcs. An arc that then crosses, overlaps or replaces another gets all its points back, until no thinned one does: a ring
neither collapses nor runs over its neighbour. Points are joined by equal coordinates, lines by the grid cells they touch,
arcs by a 128-bit digest; the largest thing in one task is one ring.

Defined cases: a null ring or one of fewer than four points stays as it is; a ring without a junction is one closed arc that
begins at its smallest point and keeps at least a triangle; the key names a ring, and rows that repeat one share its arcs; a
null key leaves its ring as it is; rings that cross in the input keep doing so; empty tables give empty tables; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.rings import RING, thinned
from ledgerloom.operators.boundaries import _touched_cells
from ledgerloom.session import Cut

#: Degrees of a grid cell in which lines are compared.
CELL = 0.05


def _ends(ring: Column) -> Column:
    """Both ends of every side of a closed ring, the smaller one first."""
    sides = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.least(F.get(ring, i), F.get(ring, i + 1)).alias("a"), F.greatest(F.get(ring, i), F.get(ring, i + 1)).alias("b")))
    return F.filter(sides, lambda s: s["a"] != s["b"])


def junctions(rings: DataFrame, layer: str) -> DataFrame:
    """(layer, point): where more than two distinct lines of the layer meet."""
    sides = rings.where("size(points) >= 4").select(layer, F.explode(_ends(F.col("points"))).alias("s")).distinct()
    met = sides.select(layer, F.explode(F.array("s.a", "s.b")).alias("point")).groupBy(layer, "point").agg(F.count("*").alias("n"))
    return met.where("n > 2").select(layer, "point")


def cut_at(points: Column, cuts: Column) -> Column:
    """The arcs of a closed ring: pieces from each place in cuts (sorted, without the last point's) to the next, around; one closed arc where there is none."""
    n = F.size(points) - 1
    smallest = F.array_position(F.slice(points, 1, n), F.array_min(F.slice(points, 1, n))).cast("int") - 1
    starts = F.when(F.size(cuts) > 0, cuts).otherwise(F.array(smallest))
    twice = F.concat(F.slice(points, 1, n), points)
    return F.transform(starts, lambda at, i: F.slice(twice, at + 1, F.when(i + 1 < F.size(starts), F.get(starts, i + 1)).otherwise(F.get(starts, F.lit(0)) + n) - at + 1))


def arcs(rings: DataFrame, key: list[str], layer: str) -> DataFrame:
    """(key.., layer, at, turned, arc, line): the arcs of every ring in order, each line in its one direction, with its digest."""
    whole = rings.where("size(points) >= 4")
    at = whole.select(*key, layer, F.posexplode(F.slice("points", 1, F.size("points") - 1)).alias("at", "point")).join(junctions(rings, layer), [layer, "point"], "left_semi")
    cuts = at.groupBy(*key, layer).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    rows = whole.join(cuts, [*key, layer], "left").select(*key, layer, F.posexplode(cut_at(F.col("points"), F.coalesce("cuts", F.array().cast("array<int>")))).alias("at", "line"))
    one = F.least("line", F.reverse("line"))
    return rows.select(*key, layer, "at", (F.col("line") != one).alias("turned"), F.md5(F.to_json(one).cast("binary")).alias("arc"), one.alias("line"))


def thinned_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay; its ends do, and a closed one keeps a triangle."""
    if len(points) < 3:
        return np.ones(len(points), bool)
    if (points[0] == points[-1]).all():
        return thinned(points, tolerance)
    keep, spans = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        (dx, dy), rest = points[b] - points[a], points[a + 1 : b] - points[a]
        off = np.abs(dx * rest[:, 1] - dy * rest[:, 0]) / np.hypot(dx, dy)  # a line's points differ, so its chords have a length
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def _thin(tolerance: float):
    @F.pandas_udf(RING)
    def thin(lines: pd.Series) -> pd.Series:
        arrays = (np.array([(p["lon"], p["lat"]) for p in line]) for line in lines)
        return pd.Series([[{"lon": x, "lat": y} for x, y in p[thinned_line(p, tolerance)].tolist()] for p in arrays], dtype=object)

    return thin.asNondeterministic()  # so marked, it is evaluated once


def crossed(lines: DataFrame, layer: str, cell: float = CELL) -> DataFrame:
    """(arc): arcs (layer, arc, thin) with a side that meets another one anywhere but at a common end."""
    sides = F.transform(F.sequence(F.lit(0), F.size("thin") - 2), lambda i: F.struct(F.get("thin", i).alias("a"), F.get("thin", i + 1).alias("b")))
    rows = lines.select(layer, "arc", F.posexplode(sides).alias("seq", "s")).select(layer, "arc", "seq", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"))
    rows = rows.withColumn("_cell", F.explode(_touched_cells(cell)))
    x, y, c = rows.alias("x"), rows.alias("y"), F.col
    cross = lambda p, q, r: (c(f"{q}x") - c(f"{p}x")) * (c(f"{r}y") - c(f"{p}y")) - (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}x") - c(f"{p}x"))
    side = lambda p, q, r: F.signum(cross(p, q, r))
    same = lambda p, q: (c(f"{p}x") == c(f"{q}x")) & (c(f"{p}y") == c(f"{q}y"))
    # from a common end, two sides overlap only if they run on one line in one direction
    along = lambda p, q, r: (cross(p, q, r) == 0) & ((c(f"{q}x") - c(f"{p}x")) * (c(f"{r}x") - c(f"{p}x")) + (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}y") - c(f"{p}y")) > 0)
    over = lambda axis: (F.greatest(f"x.a{axis}", f"x.b{axis}") >= F.least(f"y.a{axis}", f"y.b{axis}")) & (F.greatest(f"y.a{axis}", f"y.b{axis}") >= F.least(f"x.a{axis}", f"x.b{axis}"))
    meet = over("x") & over("y") & (side("y.a", "y.b", "x.a") * side("y.a", "y.b", "x.b") <= 0) & (side("x.a", "x.b", "y.a") * side("x.a", "x.b", "y.b") <= 0)
    bad = (
        F.when(same("x.a", "y.a"), along("x.a", "x.b", "y.b")).when(same("x.a", "y.b"), along("x.a", "x.b", "y.a"))
        .when(same("x.b", "y.a"), along("x.b", "x.a", "y.b")).when(same("x.b", "y.b"), along("x.b", "x.a", "y.a")).otherwise(meet)
    )
    later = (c("x.arc") < c("y.arc")) | ((c("x.arc") == c("y.arc")) & (c("x.seq") < c("y.seq")))
    hits = x.join(y, (c(f"x.{layer}") == c(f"y.{layer}")) & (c("x._cell") == c("y._cell")) & later & bad)
    return hits.select(F.explode(F.array("x.arc", "y.arc")).alias("arc")).distinct()


def simplified(rings: DataFrame, tolerance: float, key: list[str], layer: str = "level") -> DataFrame:
    """rings (key.., layer, points) with ``points`` thinned to the tolerance in degrees, shared lines alike in both neighbours.

    Each round gives arcs that cross their points back and looks again; there are as many rounds as such arcs follow from
    one another, mostly one.
    """
    made = Cut(arcs(rings, key, layer)).df
    lines = Cut(made.groupBy(layer, "arc").agg(F.first("line").alias("line")).withColumn("thin", _thin(tolerance)("line"))).df
    while True:
        reduced = lines.where("size(thin) < size(line)").select("arc")
        full = Cut(crossed(lines, layer).join(reduced, "arc", "left_semi")).df
        if full.isEmpty():
            break
        lines = Cut(lines.join(full.withColumn("_full", F.lit(True)), "arc", "left").select(layer, "arc", "line", F.when(F.col("_full"), F.col("line")).otherwise(F.col("thin")).alias("thin"))).df
    part = F.when(F.col("turned"), F.reverse("thin")).otherwise(F.col("thin"))
    parts = made.drop("line").join(lines.select(layer, "arc", "thin"), [layer, "arc"]).select(*key, layer, "at", F.slice(part, 1, F.size(part) - 1).alias("part"))
    ring = F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("at", "part"))), lambda p: p["part"]))
    joined = parts.groupBy(*key, layer).agg(ring.alias("_ring")).withColumn("_ring", F.concat("_ring", F.slice("_ring", 1, 1)))
    return rings.join(joined, [*key, layer], "left").withColumn("points", F.coalesce("_ring", "points")).select(*rings.columns)
