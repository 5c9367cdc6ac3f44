"""Readings of pages by engines: a store that any order of batches, and any replay, leaves the same.

What is kept is a minimum and a maximum, so that merging is commutative, associative and changes nothing twice: of each
reading (page, engine, version, languages, resolution) the first success, of each page and engine the last refusal.
A refusal stands unless a reading of that page and engine was first made after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ("document_id", "page_number", "engine")
READING = (*PAGE, "engine_version", "languages", "dpi")
COLUMNS = (*READING, "seq", "refusal", "content")


def folded(*batches: DataFrame) -> DataFrame:
    """Stored rows and new ones alike (COLUMNS; refusal null for a success): what the store holds after all of them."""
    rows = reduce(DataFrame.unionByName, (b.select(*COLUMNS) for b in batches))
    first = rows.where("refusal IS NULL").groupBy(*READING).agg(F.min("seq").alias("_seq"), F.min_by("content", "seq").alias("content"))
    last = rows.where("refusal IS NOT NULL").groupBy(*PAGE).agg(F.max("seq").alias("_seq"), F.max_by("refusal", "seq").alias("refusal"))
    none = F.lit(None)
    made = first.select(*READING, F.col("_seq").alias("seq"), none.cast("string").alias("refusal"), "content")
    refused = last.select(*PAGE, none.cast("string").alias("engine_version"), none.cast("string").alias("languages"), none.cast("int").alias("dpi"), F.col("_seq").alias("seq"), "refusal", none.cast("string").alias("content"))
    return made.unionByName(refused)


def standing(store: DataFrame) -> DataFrame:
    """All readings, and the refusals that no later reading of the page and engine withdrew."""
    made, refused = store.where("refusal IS NULL"), store.where("refusal IS NOT NULL")
    newest = made.groupBy(*(F.col(c).alias(f"_{c}") for c in PAGE)).agg(F.max("seq").alias("_newest"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAGE]
    left = refused.join(newest, on, "left").where(F.col("_newest").isNull() | (F.col("_newest") < F.col("seq")))
    return made.unionByName(left.select(*made.columns))


def of_document(store: DataFrame, document: int) -> DataFrame:
    """A document's standing readings in page order."""
    return standing(store.where(F.col("document_id") == document)).orderBy("page_number", "engine", "seq")


def engines_by_page(store: DataFrame) -> DataFrame:
    """(document_id, page_number, read_by, refused_by): the sets of engines, sorted."""
    sets = [F.sort_array(F.collect_set(F.when(c, F.col("engine")))).alias(n) for n, c in (("read_by", F.col("refusal").isNull()), ("refused_by", F.col("refusal").isNotNull()))]
    return standing(store).groupBy("document_id", "page_number").agg(*sets)


def benchmark(scores: DataFrame) -> DataFrame:
    """scores (engine, class, truth, found, shared) of pages: per engine and class the pages, and recall and precision over all tokens."""
    sums = scores.groupBy("engine", "class").agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("truth", "found", "shared")))
    return sums.select("engine", "class", "pages", F.round(F.try_divide("shared", "truth"), 6).alias("recall"), F.round(F.try_divide("shared", "found"), 6).alias("precision"))
