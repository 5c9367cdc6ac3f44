"""Query over outlines of a level, simplified with shared lines, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import arcs, spatial
from ledgerloom.sources.ledger import Ledger

#: Cells of a row; the side of a cell, how far a mid-point that matters and one that doesn't lies off, and the tolerance, in degrees.
WIDE, SIDE, FAR, NEAR, TOLERANCE = 64, 1 / 16, 1 / 64, 1 / 1024, 1 / 128


def _cells(spark, sf_dir):
    """Parts as cells of a grid; each side has a mid-point that lies off it, to the west or to the south, and both neighbours share it."""
    k = F.col("p_partkey").cast("int")
    rows = Ledger(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), (k % WIDE).alias("i"), F.floor(k / WIDE).cast("int").alias("j"))
    off = lambda a, b: F.when((a * 7 + b * 3) % 5 == 0, FAR).otherwise(NEAR)
    point = lambda x, y: F.struct((F.lit(70.0) + x * SIDE).alias("lon"), (F.lit(8.0) + y * SIDE).alias("lat"))
    shift = lambda p, dx, dy: F.struct((p["lon"] - dx).alias("lon"), (p["lat"] - dy).alias("lat"))
    i, j, none = F.col("i"), F.col("j"), F.lit(0.0)
    south = lambda b: shift(point(i + 0.5, b), none, off(b, i))
    west = lambda a: shift(point(a, j + 0.5), off(a, j), none)
    ring = F.array(point(i, j), south(j), point(i + 1, j), west(i + 1), point(i + 1, j + 1), south(j + 1), point(i, j + 1), west(i), point(i, j))
    return rows.select("id", F.lit("village").alias("level"), ring.alias("points"))


def level_outlines(spark, sf_dir):
    """Points, area (in squares of 1/256 degree), width and height of every cell's simplified outline; neighbours that share a line gain and lose the same."""
    rows = arcs.simplified(_cells(spark, sf_dir), TOLERANCE, ["id"])
    rows = rows.select("id", F.size("points").alias("n"), spatial.planar_area(F.col("points")).alias("area"), spatial.bbox(F.col("points")).alias("box"))
    return rows.select("id", F.col("n").alias("points"), F.round(F.col("area") * 65536, 3).alias("area"), F.round(F.col("box.east") - F.col("box.west"), 9).alias("wide"), F.round(F.col("box.north") - F.col("box.south"), 9).alias("high"))


QUERIES = [level_outlines]

SQL = {
    "level_outlines": f"""WITH c AS (SELECT p_partkey AS id, p_partkey % {WIDE} AS i, p_partkey // {WIDE} AS j FROM part),
e AS (SELECT *, (i * 7 + j * 3) % 5 = 0 AS w, ((i + 1) * 7 + j * 3) % 5 = 0 AS e, (j * 7 + i * 3) % 5 = 0 AS s, ((j + 1) * 7 + i * 3) % 5 = 0 AS n FROM c)
SELECT id, CAST(5 + w::INT + e::INT + s::INT + n::INT AS INTEGER) AS points, round(65536.0 * {SIDE * SIDE} + 65536.0 * {SIDE * FAR / 2} * (w::INT - e::INT + s::INT - n::INT), 3) AS area, round({SIDE} + w::INT * {FAR}, 9) AS wide, round({SIDE} + s::INT * {FAR}, 9) AS high FROM e""",
}
