"""Placing again what could not be placed, after a directory, the districts or the aliases changed; and placing by hand.

A directory is replaced, never merged: a version of a store lists its newest load alone. Of the held rows only those run
again that are unplaced, that nobody has decided, and whose clues meet a key whose answer changed; since each rule of the
ladder reads only the keys of its clues, the outcome is that of a full run over all such rows. A placement once held is
never replaced by a rule, and a decision stands.

Defined cases: null clues meet no key; a key that became ambiguous counts as changed and places nothing; empty tables give
empty tables; a directory's repeated rows are one; rows that share an id share their outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import resolve
from ledgerloom.operators.publication import Store
from ledgerloom.session import Cut

#: Changed keys that go to all tasks: some 10 MB. Beyond it the clues' keys are shuffled to them.
BROADCAST_KEYS = 100_000
# Fixed value: how far a reviewer's decision is trusted.
MANUAL_CONFIDENCE = 0.8


@dataclass(frozen=True)
class Directories:
    """What the ladder reads: districts (id, name_en), pincodes (pincode, district_id), offices (office, district_id), aliases (key, district_id, alias)."""

    districts: DataFrame
    pincodes: DataFrame
    offices: DataFrame
    aliases: DataFrame


def replaced(store: Store, entries: DataFrame, table: str = "directory") -> int:
    """A new version of the store whose directory is these entries alone; returns how many there are. Readers see the old one until then."""
    number, held = store.version()
    path, written = store.write(entries.distinct())
    many = written.count()
    store.publish(number + 1, held | {table: [path]})
    return many


def _answers(d: Directories) -> DataFrame:
    """(kind, key, answer): all that the ladder can learn from each key, as text."""
    told = lambda df, kind, key, *parts: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*parts)).alias("answer"))
    named = resolve.keyed(d.districts).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("district_id", "strict"))).alias("districts"))
    aliased = d.aliases.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("district_id", "alias"))).alias("aliases"))
    rows = told(named, "name", "key", "districts").unionByName(told(aliased, "alias", "key", "aliases"))
    for df, kind in ((d.pincodes, "pincode"), (d.offices, "office")):
        rows = rows.unionByName(told(resolve.unique_by(df, kind, "district_id"), kind, kind, "district_id"))
    return rows


def changed_keys(old: Directories, new: Directories) -> DataFrame:
    """(kind, key): keys that lead elsewhere than before, or that lead somewhere in one version only."""
    a, b = _answers(old).withColumnRenamed("answer", "_old"), _answers(new).withColumnRenamed("answer", "_new")
    return a.join(b, ["kind", "key"], "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select("kind", "key")


def clue_keys(clues: DataFrame) -> DataFrame:
    """(id, kind, key): every key that the ladder may look up for a clue row."""
    name = text.district_key(F.col("district_name"))
    parts = F.concat(F.split("location", resolve.PIECES), F.split("location", "[^A-Za-z]+"))
    parts = F.transform(F.filter(parts, lambda p: F.length(p) > 0), text.district_key)
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    located = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda k: one("name", k))
    every = F.concat(F.array(one("name", name), one("alias", name), one("pincode", F.col("pincode")), one("office", F.col("office"))), located)
    return clues.select("id", F.explode(F.array_distinct(every)).alias("k")).select("id", "k.*").where("key != ''")


def affected(clues: DataFrame, changed: DataFrame) -> DataFrame:
    """The clue rows with a key among the changed ones."""
    held = Cut(changed).df
    few = held.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    met = clue_keys(clues).join(F.broadcast(held) if few else held, ["kind", "key"], "left_semi").select("id").distinct()
    return clues.join(met, "id", "left_semi")


def reresolved(held: DataFrame, clues: DataFrame, decided: DataFrame, old: Directories, new: Directories) -> DataFrame:
    """held (id, district_id, method, confidence, evidence) after the change, with outcome.

    outcome: 'decided' (id among the decided), 'held' (placed before), 'placed' (by this run), 'unplaced' (its clues were
    read again in vain), 'unmet' (no clue of it changed). Unplaced rows must be unplaced by the old directories.
    """
    open_rows = held.where("district_id IS NULL").select("id").join(decided.select("id"), "id", "left_anti")
    again = affected(clues.join(open_rows, "id", "left_semi"), changed_keys(old, new))
    found = resolve.resolve(again, new.districts, new.pincodes, new.offices, new.aliases)
    fields = ["district_id", "method", "confidence", "evidence"]
    found = found.select("id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_again")).dropDuplicates(["id"])
    rows = held.join(found, "id", "left").join(decided.select("id", F.lit(True).alias("_decided")).distinct(), "id", "left")
    outcome = F.when(F.col("_decided"), "decided").when(F.col("district_id").isNotNull(), "held").when(F.col("_district_id").isNotNull(), "placed").when(F.col("_again"), "unplaced").otherwise("unmet")
    return rows.select("id", *(F.when(F.col("_district_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), outcome.alias("outcome"))


def placed_by_hand(decisions: DataFrame, tenders: DataFrame, portals: DataFrame, units: DataFrame) -> DataFrame:
    """Every decision with the tender and district it places, or the reason why it is refused.

    decisions: decision_id, portal_code, portal_tender_id, lgd_code (null: can't be placed), decided_by, reason; they take
    effect in the order of their ids. tenders: id, portal_code, portal_tender_id, admin_unit_id. portals: portal_code,
    state_lgd_code. units: id, level, lgd_code, name_en, parent_id. "Can't be placed" is refused for a tender that is placed
    already, be it by an earlier decision of the same table. Column ``last`` marks the decision whose district holds.
    """
    states = units.where("level = 'state'").select(F.col("id").alias("parent_id"), F.col("lgd_code").alias("state_lgd_code"))
    districts = units.where("level = 'district'").join(states, "parent_id").select("state_lgd_code", "lgd_code", F.col("id").alias("admin_unit_id"), F.col("name_en").alias("district"))
    t = tenders.select("portal_code", "portal_tender_id", F.col("id").alias("tender_id"), F.col("admin_unit_id").isNotNull().alias("_placed"))
    rows = decisions.join(t, ["portal_code", "portal_tender_id"], "left").join(portals.select("portal_code", "state_lgd_code"), "portal_code", "left").join(districts, ["state_lgd_code", "lgd_code"], "left")
    blank: Column = (F.coalesce(F.trim("decided_by"), F.lit("")) == "") | (F.coalesce(F.trim("reason"), F.lit("")) == "")
    refused = (
        F.when(blank, "a decision needs the reviewer's name and a reason").when(F.col("tender_id").isNull(), "no such tender on the portal")
        .when(F.col("state_lgd_code").isNull(), "the portal has no state").when(F.col("lgd_code").isNotNull() & F.col("admin_unit_id").isNull(), "not a district of the tender's state")
    )
    rows = rows.withColumn("_refused", refused).withColumn("_places", F.col("_refused").isNull() & F.col("lgd_code").isNotNull())
    # a decision that no tender bears has a key of its own, so that all of them don't meet in one window
    own = F.coalesce("tender_id", -1 - F.abs(F.col("decision_id")))
    before = W.partitionBy("_own").orderBy("decision_id").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("_own").orderBy("decision_id").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("_own", own).withColumn("_already", F.col("_placed") | F.coalesce(F.max("_places").over(before), F.lit(False))).withColumn("_later", F.coalesce(F.max("_places").over(after), F.lit(False)))
    refused = F.coalesce("_refused", F.when(F.col("lgd_code").isNull() & F.col("_already"), "already placed; decide a district, or leave it"))
    placed = lambda c: F.when(F.col("_places"), c)
    return rows.select(
        "decision_id", "tender_id", placed(F.col("admin_unit_id")).alias("admin_unit_id"), placed(F.col("district")).alias("district"), placed(F.lit("manual")).alias("method"), placed(F.lit(MANUAL_CONFIDENCE).cast("decimal(4,3)")).alias("confidence"),
        placed(F.concat(F.lit("decision:"), F.col("decision_id").cast("string"))).alias("evidence"), (F.col("_places") & ~F.col("_later")).alias("last"), refused.alias("refused"),
    )
