"""Connected components of a table of links, with DataFrame joins only.

Large-star and small-star steps alternate: each moves links towards the smallest id around, until every
id links straight to the smallest id of its component. A hot id's neighbours are only ever aggregated
to their minimum or joined to one row, which Spark's adaptive skew handling can split. Each round is
written to the shared folder, so lineage stays short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct (a, b) with a > b. Each id's partners are linked to the smallest of id and partners.

    The large star moves an id's larger partners, the small star its smaller ones and the id itself.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id with a link to another one; component is the smallest id reachable. Null ends are no links."""
    held = Cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _state(held.df)
    while before[0]:
        after = Cut(_star(_star(held.df, large=True), large=False))
        held.drop()
        held, state = after, _state(after.df)
        if state == before:
            break
        before = state
    roots = held.df.select(F.col("b").alias("id")).distinct()
    return held.df.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
