"""Merging what was just read with what is held: upserts, refresh plans, occurrence numbers, histories.

Tables are Parquet, so a merge is a full outer join on the identity and a new version of the table. Each
function returns the merged rows or a plan of actions; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed(a: str, b: str, columns: list[str]) -> Column:
    """Whether any of the columns differs, null-safe: one comparison of two structs."""
    return ~F.struct(*[F.col(f"{a}.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"{b}.{c}") for c in columns]))


def numbered(rows: DataFrame, identity: list[str], *order: str) -> DataFrame:
    """Rows with _n, the how-manieth of its identity each one is, from 0, by the order columns."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*identity).orderBy(*order)) - 1)


def first_of_each(rows: DataFrame, identity: list[str], *order: Column) -> DataFrame:
    """The first row of each identity in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*identity).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(held: DataFrame, read: DataFrame, key: list[str], overwrite: list[str], coalesce: list[str], as_one: list[str] = (), guard: Column | None = None, fixed: list[str] = ()) -> DataFrame:
    """Merged rows with _status: inserted, updated, unchanged or kept (not read this time).

    overwrite: taken as read; coalesce: what was read unless that is null; as_one: moves together if its
    first column was read, unless ``guard`` (over h.*) holds; fixed: never changed once held.
    """
    h, r = held.alias("h"), read.alias("r")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"h.{k}") == F.col(f"r.{k}"))
    both = h.join(r, on, "full_outer")
    new, gone = F.col(f"h.{key[0]}").isNull(), F.col(f"r.{key[0]}").isNull()
    out = [F.coalesce(f"r.{k}", f"h.{k}").alias(k) for k in key]
    value = {c: F.when(gone, F.col(f"h.{c}")).otherwise(F.col(f"r.{c}")) for c in overwrite}
    value |= {c: F.coalesce(f"r.{c}", f"h.{c}") for c in coalesce}
    if as_one:
        stays = gone | F.col(f"r.{as_one[0]}").isNull() & ~new
        stays = stays | (~new & F.coalesce(guard, F.lit(False))) if guard is not None else stays
        value |= {c: F.when(stays, F.col(f"h.{c}")).otherwise(F.col(f"r.{c}")) for c in as_one}
    value |= {c: F.coalesce(f"h.{c}", f"r.{c}") for c in fixed}
    compared = [c for c in value if c not in fixed]
    same = F.struct(*[value[c] for c in compared]).eqNullSafe(F.struct(*[F.col(f"h.{c}") for c in compared]))
    status = F.when(new, "inserted").when(gone, "kept").when(same, "unchanged").otherwise("updated")
    return both.select(*out, *[v.alias(c) for c, v in value.items()], status.alias("_status"))


def refresh_plan(source: DataFrame, target: DataFrame, identity: list[str], carried: list[str], decided: Column, order: str = "id") -> DataFrame:
    """One row an identity and occurrence with its action: insert, update, keep, retire, or stranded (decided, but gone from the source).

    ``decided`` is a condition over the target's columns. Applied to its own result, the plan is all keep. Occurrences of
    one identity and order come in the order of their carried values, so that the plan is the same at every run.
    """
    s, t = (numbered(rows, identity, order, *carried).alias(a) for rows, a in ((source, "s"), (target.withColumn("_decided", decided), "t")))
    on = F.col("s._n") == F.col("t._n")
    for c in identity:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    both = s.join(t, on, "full_outer")
    action = (
        F.when(F.col("t._n").isNull(), "insert")
        .when(F.col("s._n").isNull(), F.when(F.col("t._decided"), "stranded").otherwise("retire"))
        .when(changed("s", "t", carried), "update")
        .otherwise("keep")
    )
    ids = [F.when(F.col("s._n").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in identity]
    return both.select(*ids, F.coalesce("s._n", "t._n").alias("occurrence"), F.col(f"s.{order}").alias("source_id"), F.col(f"t.{order}").alias("target_id"), action.alias("action"))


def versions(readings: DataFrame, key: list[str], order: str, tracked: list[str], moment: Column | None = None) -> DataFrame:
    """Superseded readings: each reading that the next one of its key changes, with when it was superseded.

    Times are compared as given in ``tracked``; truncate them first where small differences are no change. Readings of
    the same time come in the order of their tracked values, so that the history is the same at every run.
    """
    w = W.partitionBy(*key).orderBy(moment if moment is not None else F.col(order), order, *tracked)
    nxt = F.lead(F.struct(*tracked)).over(w)
    rows = readings.withColumn("_next", nxt).withColumn("superseded_at", F.lead(order).over(w))
    return rows.where(F.col("_next").isNotNull() & ~F.col("_next").eqNullSafe(F.struct(*tracked))).drop("_next")


def reconcile_sets(wanted: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """The keys to add and to delete so that what is held is what is wanted."""
    add = wanted.select(*key).distinct().join(held, key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(held.select(*key).distinct().join(wanted, key, "left_anti").withColumn("action", F.lit("delete")))


def paced(requests: DataFrame, at: str, most: int, hours: int = 1) -> DataFrame:
    """Requests with how many came in the trailing hours before them, and whether intake was paused by then.

    The count needs every request of the span, so each request is copied to its own hour and the next, and judged in the
    hour that it belongs to. Copies stand a span later, where they leave the trailing hour: what is counted is the hour's own
    requests so far and the copies that haven't left yet. These are running counts, so a crowded hour costs no more a request.
    """
    span = 3600 * hours
    second = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    slot = F.floor(second / span)
    marked = requests.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_slot", slot)
    spread = marked.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_in", F.col("_slot") + F.col("_copy")).withColumn("_t", F.col("_t") + F.col("_copy") * (span * 1_000_000))
    hour = W.partitionBy("_in")
    before = hour.orderBy("_t").rangeBetween(W.unboundedPreceding, -1)
    so_far = F.count(F.when(F.col("_copy") == 0, 1)).over(before) - F.count(F.when(F.col("_copy") == 1, 1)).over(before)
    counted = spread.withColumn("recent", so_far + F.sum("_copy").over(hour)).where("_copy = 0 AND _slot IS NOT NULL")
    return counted.withColumn("paused", F.col("recent") >= most).drop("_t", "_slot", "_in", "_copy")
