"""Placing a tender in a district: a ladder of rules, the strongest first, each with its evidence and confidence.

A rule that finds no or several districts places nothing: a wrong placement is worse than none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text

# How far each method is trusted.
CONFIDENCE = {"chain_unit": 0.9, "office_code": 0.6, "location_district": 0.7, "pincode": 0.6, "place_name": 0.4}
MIN_LOOSE, MIN_WORD, MIN_PLACE = 6, 4, 5
PIECES = r"(?i)[,|/()]+|\s-\s|\band\b"


def confidence(method: Column) -> Column:
    table = F.create_map(*[F.lit(x) for m, c in CONFIDENCE.items() for x in (m, c)])
    return F.try_element_at(table, method).cast("decimal(4,3)")


def unique_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that lead to exactly one value; min and max tell, so no set is gathered."""
    both = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return both.where("_low = _high").select(key, F.col("_low").alias(value))


def keyed(districts: DataFrame) -> DataFrame:
    """(district_id, key, strict): districts (id, name_en) by their comparison keys."""
    return districts.select(F.col("id").alias("district_id"), text.district_key(F.col("name_en")).alias("key"), text.strict_key(F.col("name_en")).alias("strict"))


def by_location(clues: DataFrame, districts: DataFrame) -> DataFrame:
    """Exactly one district named by whole pieces of the location, and no other by any word in it."""
    index = keyed(districts)
    at = clues.where(F.col("location").isNotNull()).select("id", "location")
    pieces = at.select("id", F.explode(F.split("location", PIECES)).alias("piece")).select("id", text.district_key(F.col("piece")).alias("key"), text.strict_key(F.col("piece")).alias("own"))
    whole = pieces.where("key != ''").join(index, "key").where((F.col("own") == F.col("strict")) | (F.length("own") >= MIN_LOOSE)).select("id", "district_id", F.lit(True).alias("whole"))
    words = at.select("id", F.explode(F.split("location", "[^A-Za-z]+")).alias("word")).where(F.length("word") >= MIN_WORD).select("id", text.district_key(F.col("word")).alias("key"), text.strict_key(F.col("word")).alias("own"))
    worded = words.where("key != ''").join(index, "key").where(F.col("own") == F.col("strict")).select("id", "district_id", F.lit(False).alias("whole"))
    found = whole.unionByName(worded).groupBy("id").agg(F.min("district_id").alias("_low"), F.max("district_id").alias("_high"), F.bool_or("whole").alias("_whole"))
    return found.where("_whole AND _low = _high").join(at, "id").select("id", F.col("_low").alias("district_id"), F.lit("location_district").alias("method"), F.trim("location").alias("evidence"))


def resolve(clues: DataFrame, districts: DataFrame, pincodes: DataFrame | None = None, offices: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Every clue row with its placement, or none: id, district_id, method, confidence, evidence.

    clues: id, district_name, district_source, location, pincode, office. In order: the district that is
    named, as spelled or by a reviewed alias (key, district_id, alias); the only one that the location names;
    the only one of the pincode's offices (pincode, district_id); the only one of the post office (office,
    district_id). One pass of left joins; only clues with a location are exploded.
    """
    rows = clues.withColumn("_key", text.district_key(F.col("district_name")))
    rows = rows.join(keyed(districts).select(F.col("key").alias("_key"), F.col("district_id").alias("_named")), "_key", "left")
    none = F.struct(F.lit(None).cast("long").alias("district_id"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("evidence"))

    def step(found: str, method: Column, evidence: Column) -> Column:
        return F.when(F.col(found).isNotNull(), F.struct(F.col(found).alias("district_id"), method.alias("method"), evidence.cast("string").alias("evidence")))

    ladder = [step("_named", F.col("district_source"), F.lit(None))]
    if aliases is not None:
        rows = rows.join(aliases.select(F.col("key").alias("_key"), F.col("district_id").alias("_aliased"), "alias"), "_key", "left")
        ladder.append(step("_aliased", F.col("district_source"), F.concat(F.lit("alias:"), F.col("alias"))))
    located = by_location(clues, districts).select("id", F.col("district_id").alias("_located"), F.col("evidence").alias("_text"))
    rows = rows.join(located, "id", "left")
    ladder.append(step("_located", F.lit("location_district"), F.col("_text")))
    for directory, key, method in ((pincodes, "pincode", "pincode"), (offices, "office", "place_name")):
        if directory is not None:
            rows = rows.join(unique_by(directory, key, "district_id").withColumnRenamed("district_id", f"_{key}"), key, "left")
            ladder.append(step(f"_{key}", F.lit(method), F.col(key)))
    found = F.coalesce(*ladder, none)
    return rows.select("id", found.alias("f")).select("id", "f.district_id", "f.method", confidence(F.col("f.method")).alias("confidence"), "f.evidence")
