"""The administrative tree: closure, ancestors, subtrees, nearest findings.

Each level is a join on the parent, planned by Catalyst, until a level is empty; a level is written before the next
one is built, so plans stay short. Every unit's chain is built upwards, which keeps a hot parent (a state with most
units) on the build side of the join. A tree deeper than MAX_DEPTH has a cycle and is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Levels that no administrative tree has.
MAX_DEPTH = 50


def _levels(level: DataFrame, below, depth: int | None) -> DataFrame:
    """The union of a level and those after it, as far as asked for or until one is empty."""
    out, most = level, MAX_DEPTH if depth is None else depth
    for d in range(1, most + 1):
        level = below(level, d)
        if depth is None:
            level = cut(level)
            if level.isEmpty():
                return out
        out = out.unionByName(level)
    if depth is None and not below(level, most + 1).isEmpty():
        raise ValueError(f"the tree is deeper than {MAX_DEPTH} levels: a unit is its own ancestor")
    return out


def closure(units: DataFrame, depth: int | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, depth) of each unit with itself and its ancestors, up to the root or ``depth`` levels up."""
    parents = units.select(F.col("id").alias("_id"), F.col("parent_id").alias("_next"))
    own = units.select(F.col("id").alias("descendant_id"), F.col("id").alias("ancestor_id"), F.col("parent_id").alias("next"), F.lit(0).alias("depth"))
    up = lambda level, d: level.where("next IS NOT NULL").join(parents, F.col("next") == F.col("_id")).select("descendant_id", F.col("_id").alias("ancestor_id"), F.col("_next").alias("next"), F.lit(d).alias("depth"))
    return _levels(own, up, depth).select("ancestor_id", "descendant_id", "depth")


def ancestors(units: DataFrame, unit_id: int, depth: int | None = None) -> DataFrame:
    """The chain of one unit, from itself upwards: id, level, name_en, depth. Each step is one filtered look-up."""
    own = units.where(F.col("id") == unit_id).withColumn("depth", F.lit(0))
    up = lambda step, d: units.join(F.broadcast(step.select(F.col("parent_id").alias("_up")).limit(1)), F.col("id") == F.col("_up"), "left_semi").withColumn("depth", F.lit(d))
    return _levels(own, up, depth).select("id", "level", "name_en", "depth")


def within(units: DataFrame, top: DataFrame, depth: int | None = None) -> DataFrame:
    """Ids of the units under (and including) the given top units, by levels downwards."""
    down = lambda level, d: units.join(level.withColumnRenamed("id", "_p"), F.col("parent_id") == F.col("_p"), "left_semi").select("id")
    return _levels(top.select("id"), down, depth)


def nearest_finding(findings: DataFrame, chain: DataFrame) -> DataFrame:
    """Of findings on a unit and its ancestors, the nearest one of each level; inherited if it is an ancestor's.

    findings: (admin_unit_id, level, ...); chain: (descendant_id, ancestor_id, depth).
    """
    found = findings.join(chain, F.col("admin_unit_id") == F.col("ancestor_id"))
    w = W.partitionBy("descendant_id", "level").orderBy("depth")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("inherited", F.col("depth") > 0).drop("_n")
