"""Publication of a reviewed ledger: tables in new ids, counts compared, a version that appears only if they agree.

A store is a folder. Tables lie in it as segments, Parquet that nobody reads yet; a version is a list of the segments
of each table. A promotion writes its segments, reads them back, compares the counts with the source's and only then
writes the next version. Whatever fails before that leaves readers on the old version, and what was written is
never seen. Nothing is copied that a version already holds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.reconcile import numbered
from ledgerloom.operators.reviews import reserved

TABLES = ("document", "page", "fact", "history")
# Reviews after which a fact is published.
PUBLISHED = ("verified", "corrected")


class PromotionRefused(Exception):
    """The source can't be promoted as it is; nothing was published."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def version(self) -> tuple[int, dict[str, list[str]]]:
        """The newest version's number and its segments by table; 0 and none where nothing was published."""
        try:
            rows = self.spark.read.schema("segments array<struct<table:string,path:string>>, version int").parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        newest = rows.orderBy(F.desc("version")).first()  # a row a version
        held: dict[str, list[str]] = {}
        for table, path in newest["segments"] if newest else ():
            held.setdefault(table, []).append(path)
        return (newest["version"] if newest else 0), held

    def table(self, name: str) -> DataFrame | None:
        """A table of the newest version, or None."""
        paths = self.version()[1].get(name)
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """A new segment: its path and what was written."""
        path = f"{self.root}/segments/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def publish(self, number: int, segments: dict[str, list[str]]) -> None:
        """The version appears with its one file; a second writer of the same number is refused."""
        listed = [(t, p) for t, paths in segments.items() for p in paths]
        one = self.spark.createDataFrame([(listed,)], "segments array<struct<table:string,path:string>>").coalesce(1)
        one.write.mode("errorifexists").parquet(f"{self.root}/versions/version={number}")


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Documents, pages, facts, published facts and history rows."""
    out = {name: tables[name].count() for name in TABLES}
    return out | {"published": tables["fact"].where(F.col("verification_status").isin(*PUBLISHED)).count()}


def _next_id(held: DataFrame | None) -> int:
    return 1 + ((held.agg(F.max("id")).first()[0] or 0) if held is not None else 0)


def _renumbered(rows: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their new ids, and the map from old to new."""
    ids = reserved(rows, "id", start).select(F.col("id").alias("_old"), "new_id")
    return rows.join(ids, rows["id"] == ids["_old"]).drop("id", "_old").withColumnRenamed("new_id", "id"), ids


def promote(store: Store, source: dict[str, DataFrame], units: DataFrame, expected: dict[str, int] | None = None) -> dict[str, int]:
    """Publish the source's documents that the store lacks, with their pages, facts and history, as one version.

    source: document (id, sha256, level, lgd_code, ..), page (id, document_id, ..), fact (id, document_id, same_figure_as,
    verification_status, ..), history (id, fact_id, ..). units: the store's places (id, level, lgd_code). A document's
    place is found by level and code; one that the store doesn't hold refuses the whole promotion. A link to a fact that
    isn't promoted with it is dropped. ``expected`` replaces the source's own counts. Returns the counts and the version.
    """
    number, held = store.version()
    present = {name: store.table(name) for name in TABLES}
    documents = source["document"]
    if present["document"] is not None:
        documents = documents.join(present["document"].select("sha256"), "sha256", "left_anti")
    placed = documents.join(units.select(F.col("id").alias("admin_unit_id"), "level", "lgd_code"), ["level", "lgd_code"], "left")
    lost = placed.where("level IS NOT NULL AND lgd_code IS NOT NULL AND admin_unit_id IS NULL").agg(F.count("*"), F.min(F.struct("level", "lgd_code"))).first()
    if lost[0]:
        raise PromotionRefused(f"{lost[0]} documents are attributed to places that the store doesn't hold, such as {lost[1]['level']} {lost[1]['lgd_code']}")
    _, documents = store.write(placed.drop("level", "lgd_code"))  # decided once; all that follows reads this
    ours = documents.select(F.col("id").alias("document_id"))
    of_ours = {"document": documents, **{n: source[n].join(ours, "document_id", "left_semi") for n in ("page", "fact")}}
    of_ours["history"] = source["history"].join(of_ours["fact"].select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    wanted = expected or counts(of_ours)

    written: dict[str, tuple[str, DataFrame]] = {}
    new_documents, document_ids = _renumbered(documents, _next_id(present["document"]))
    written["document"] = store.write(new_documents)
    document_ids = document_ids.select(F.col("_old").alias("document_id"), F.col("new_id").alias("_document"))
    inside = lambda rows: rows.join(document_ids, "document_id").drop("document_id").withColumnRenamed("_document", "document_id")
    written["page"] = store.write(inside(_renumbered(of_ours["page"], _next_id(present["page"]))[0]))
    facts, fact_ids = _renumbered(of_ours["fact"], _next_id(present["fact"]))
    links = fact_ids.select(F.col("_old").alias("same_figure_as"), F.col("new_id").alias("_link"))
    linked = facts.join(links, "same_figure_as", "left").withColumn("link_dropped", F.col("same_figure_as").isNotNull() & F.col("_link").isNull())
    written["fact"] = store.write(inside(linked.drop("same_figure_as").withColumnRenamed("_link", "same_figure_as")))
    owners = fact_ids.select(F.col("_old").alias("fact_id"), F.col("new_id").alias("_fact"))
    history = _renumbered(of_ours["history"], _next_id(present["history"]))[0].join(owners, "fact_id").drop("fact_id").withColumnRenamed("_fact", "fact_id")
    written["history"] = store.write(history)

    actual = counts({name: df for name, (_, df) in written.items()})
    for name, n in actual.items():
        if n != wanted[name]:
            raise PromotionRefused(f"{name}: {n} written, {wanted[name]} expected; nothing was published")
    if actual["document"]:
        store.publish(number + 1, {name: [*held.get(name, []), written[name][0]] for name in TABLES})
    return actual | {"version": number + bool(actual["document"])}


IDENTITY = ("document_id", "page_number", "kind", "raw_text")


def refreshed(held: DataFrame, read: DataFrame, values: list[str]) -> DataFrame:
    """The facts of documents that both sides hold, made to agree with what was read; with _action.

    Facts are told by document, page, kind, text and their how-manieth occurrence. Read ones replace the held values
    (kept or updated) or come in (inserted, id null); a held fact that wasn't read goes if nobody reviewed it (retired)
    and stays otherwise (reviewed). Documents that weren't read at all are left alone.
    """
    h, r = numbered(held, list(IDENTITY), "id").alias("h"), numbered(read, list(IDENTITY), "id").alias("r")
    documents = read.select("document_id").distinct().withColumn("_read", F.lit(True))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*IDENTITY, "_n")]
    both = h.join(r, on, "full_outer")
    same = F.struct(*[F.col(f"h.{c}") for c in values]).eqNullSafe(F.struct(*[F.col(f"r.{c}") for c in values]))
    action = (
        F.when(F.col("h.id").isNull(), "inserted").when(F.col("r.id").isNotNull(), F.when(same, "kept").otherwise("updated"))
        .when(F.col("h.verification_status") == "unverified", "retired").otherwise("reviewed")
    )
    chosen = [F.when(F.col("r.id").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in values]
    rows = both.select(F.col("h.id").alias("id"), *(F.coalesce(F.col(f"h.{c}"), F.col(f"r.{c}")).alias(c) for c in IDENTITY), *chosen, action.alias("_action"))
    return rows.join(documents, "document_id", "left").withColumn("_action", F.when(F.col("_read").isNull(), "kept").otherwise(F.col("_action"))).drop("_read")


def refresh(store: Store, read: DataFrame, values: list[str]) -> dict[str, int]:
    """Publish the refreshed facts as a version in which they replace the held ones; refused if they disagree with what was read."""
    number, held = store.version()
    facts = store.table("fact")
    if facts is None:
        raise PromotionRefused("the store holds no facts to refresh")
    planned = refreshed(facts, read, values)
    _, plan = store.write(planned)
    _, new = store.write(plan.where("_action = 'inserted'").withColumn("_key", F.monotonically_increasing_id()))  # written, so that keys stay
    inserted = new.join(reserved(new, "_key", _next_id(facts)), "_key").withColumn("id", F.col("new_id")).drop("new_id", "_key")
    path, written = store.write(plan.where("_action NOT IN ('inserted', 'retired')").unionByName(inserted))
    done = dict(plan.groupBy("_action").agg(F.count("*")).collect())  # five actions
    agree = written.where("_action IN ('kept', 'updated', 'inserted')").join(read.select("document_id").distinct(), "document_id", "left_semi").count()
    wanted = read.count()
    if agree != wanted:
        raise PromotionRefused(f"fact: {agree} agree, {wanted} expected; nothing was published")
    store.publish(number + 1, held | {"fact": [path]})
    return done | {"version": number + 1}

