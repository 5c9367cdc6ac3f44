"""Places that pages name: word runs of sentences joined to a gazetteer, the longest name first, no overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import text

# How a place is written as a fact, its trust, and the shortest name.
SUFFIX = {"district": "district", "sub_district": "taluka"}
TRUST = {"district": 0.8, "sub_district": 0.7}
SHORTEST = 4
#: Names of a gazetteer beyond which the runs are shuffled to them.
BROADCAST_NAMES = 200_000


def unambiguous(entries: DataFrame) -> DataFrame:
    """(name, level): all districts; talukas whose name is theirs alone, is no district's and is not too short."""
    bare = entries.select(F.trim(F.regexp_replace("name", r"(?i)\s+District$", "")).alias("name"), "level")
    districts = bare.where("level = 'district'").distinct()
    talukas = bare.where("level = 'sub_district'").groupBy("name").agg(F.count("*").alias("_n")).where((F.col("_n") == 1) & (F.length("name") >= SHORTEST))
    return districts.unionByName(talukas.join(districts.select("name"), "name", "left_anti").select("name", F.lit("sub_district").alias("level")))


def place_value(name: F.Column, level: F.Column) -> F.Column:
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
    return F.concat_ws(" ", name, F.try_element_at(suffix, level))


def parse_place_value(value: F.Column) -> F.Column:
    """struct(name, level) of a place fact, or null."""
    v = F.trim(value)
    found = None
    for level, suffix in SUFFIX.items():
        ends = F.endswith(F.lower(v), F.lit(f" {suffix}")) & (F.length(F.trim(v)) > len(suffix) + 1)
        part = F.struct(F.trim(F.substring(v, F.lit(1), F.length(v) - len(suffix) - 1)).alias("name"), F.lit(level).alias("level"))
        found = F.when(ends, part) if found is None else found.when(ends, part)
    return found


def places_in(pages: DataFrame, gazetteer: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, value, sentence, confidence): each place once a page, at its first sentence; longer names claim their words first."""
    parts = pages.repartition(id_col).select(F.col(id_col).alias("id"), F.posexplode(text.sentences(F.col(text_col))).alias("sentence", "_s"))
    words = parts.select("id", "sentence", F.transform(F.split("_s", " "), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("_w"))
    starts = F.transform("_w", lambda w, i: i)
    # a page's runs are as long as the names are: only lengths that occur are built
    counted = dict(gazetteer.groupBy(F.size(F.split("name", " "))).count().collect())
    lengths = sorted(counted) or [1]
    runs = F.flatten(F.transform(F.lit(lengths), lambda n: F.transform(F.filter(starts, lambda i: i + n <= F.size("_w")), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, n), " ").alias("run"), i.alias("at"), (i + n).alias("end")))))
    each = words.select("id", "sentence", F.explode(runs).alias("r")).select("id", "sentence", "r.run", "r.at", "r.end").where("run != ''")
    names = gazetteer.select("name", "level", F.explode(F.array_distinct(F.array(F.col("name"), F.upper("name")))).alias("run"))
    # the optimizer takes the runs for as small as the pages and would send them all to every task: it is the names that go, if they are few
    names, each = (F.broadcast(names), each) if sum(counted.values()) <= BROADCAST_NAMES else (names, each.hint("merge"))
    hits = each.join(names, "run").groupBy("id", "sentence").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("size"), "at", "end", "name", "level"))).alias("h"))
    none = F.expr("cast(array() AS array<struct<size: int, at: int, end: int, name: string, level: string>>)")
    free = F.aggregate("h", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["at"] < x["end"]) & (y["end"] > x["at"])), acc).otherwise(F.array_append(acc, x)))
    chosen = hits.select("id", "sentence", F.explode(free).alias("p")).select("id", "sentence", "p.at", place_value(F.col("p.name"), F.col("p.level")).alias("value"), F.col("p.level").alias("level"))
    first = chosen.withColumn("_n", F.row_number().over(W.partitionBy("id", "value").orderBy("sentence", "at"))).where("_n = 1")
    trust = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    return first.select("id", "value", "sentence", F.try_element_at(trust, F.col("level")).alias("confidence"))
