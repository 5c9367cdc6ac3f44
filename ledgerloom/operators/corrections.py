"""Correction requests and corrected figures: intake problems, decisions folded over a log, batches taken whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import money

# Categories and statuses of requests, shapes of what they are about, and lengths.
CATEGORIES = ("amount_wrong", "name_wrong", "place_wrong", "document_wrong", "duplicate", "outdated", "missing", "other")
OPEN = ("received", "reviewing")
FINAL = ("corrected", "no_change", "not_actionable")
RECORD_SUBJECT, PAGE_SUBJECT, WEB_ADDRESS = r"^(fact|document|body|unit|tender):[1-9][0-9]{0,18}$", r"(?U)^page:/\S*$", r"(?U)^https?://\S+$"
MOST_SUBJECT, LEAST_DESCRIPTION, MOST_DESCRIPTION, MOST_ADDRESS = 306, 10, 4000, 1000
QUEUE = 500


def problems(subject: Column, category: Column, description: Column, address: Column, hidden: Column) -> Column:
    """What is wrong with a request, in the form's order; an empty array is a sound one. hidden: a field that people don't see."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    about, text, url = clean(subject), clean(description), clean(address)
    found = F.array(
        F.when(clean(hidden) != "", "automated"),
        F.when(~(about.rlike(RECORD_SUBJECT) | (about.rlike(PAGE_SUBJECT) & (F.length(about) <= MOST_SUBJECT))), "subject"),
        F.when(~clean(category).isin(*CATEGORIES), "category"),
        F.when(F.length(text) < LEAST_DESCRIPTION, "description_short"),
        F.when(F.length(text) > MOST_DESCRIPTION, "description_long"),
        F.when((url != "") & (~url.rlike(WEB_ADDRESS) | (F.length(url) > MOST_ADDRESS)), "evidence_url"),
    )
    return F.array_compact(found)


def open_requests(current: DataFrame) -> DataFrame:
    """Requests that await a decision, oldest first."""
    return current.where(F.col("status").isin(*OPEN)).orderBy("received_at", "reference")


def _log(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision with its outcome and the request's state before and after it.

    A refused decision leaves the state alone. Who decided and when is that of the last final decision, the note the last
    one given. A request's decisions are ordered in one task; requests, not rows, are what a task gets many of.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    final = F.col("status").isin(*FINAL)
    known = decisions.join(requests.select("reference", F.lit(True).alias("_known")), "reference", "left")
    outcome = (
        F.when(F.col("_known").isNull(), "unknown_reference").when(~(final | (F.col("status") == "reviewing")) | F.col("status").isNull(), "unknown_status")
        .when(blank("reviewer"), "no_reviewer").when(final & blank("note"), "no_note").otherwise("decided")
    )
    rows = known.withColumn("outcome", outcome).withColumn("_takes", F.col("outcome") == "decided").withColumn("_final", F.col("_takes") & final)
    upto = W.partitionBy("reference").orderBy("seq")
    last = lambda when, c, over: F.last(F.when(F.col(when), F.col(c)), ignorenulls=True).over(over)
    state = lambda over: F.struct(
        F.coalesce(last("_takes", "status", over), F.lit("received")).alias("status"), last("_final", "reviewer", over).alias("decided_by"), last("_final", "at", over).alias("decided_at"), last("_takes", "note", over).alias("resolution_note")
    )
    before, after = upto.rowsBetween(W.unboundedPreceding, -1), upto.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("before", state(before)).withColumn("after", state(after)).drop("_known", "_takes", "_final")


def outcomes(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (seq, reference, status, reviewer, note, at) with outcome: decided, or why it was refused."""
    return _log(requests, decisions).drop("before", "after")


def history(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each state of a request that a decision replaced by another one: reference, that state, superseded_at."""
    log = _log(requests, decisions).where("outcome = 'decided'")
    return log.where(~F.col("before").eqNullSafe(F.col("after"))).select("reference", "seq", "before.*", F.col("at").alias("superseded_at"))


def current(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """All requests (reference, received_at, ..) in their state after all decisions."""
    newest = _log(requests, decisions).where("outcome != 'unknown_reference'").groupBy("reference").agg(F.max_by("after", "seq").alias("_s"))
    rows = requests.join(newest, "reference", "left")
    state = [F.col(f"_s.{c}").alias(c) for c in ("decided_by", "decided_at", "resolution_note")]
    return rows.select(*requests.columns, F.coalesce("_s.status", F.lit("received")).alias("status"), *state)


def prepared(corrections: DataFrame, batch: str = "batch") -> DataFrame:
    """corrections (batch, id, amount, unit, note) with paise, problem and taken: a batch with any problem is not taken at all.

    Amounts go through the one money path; what isn't exact to the paisa is a problem. The batches' problems are counted
    by an aggregate that joins back, so that a large batch is no single task's work.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    paise = F.when(F.col("unit") == "rupees", money.amount_to_paise(F.col("amount"), F.lit(None).cast("string"), True)).otherwise(money.amount_to_paise(F.col("amount"), F.col("unit")))
    problem = F.when(F.col("id").isNull(), "id").when(blank("amount"), "amount").when(blank("unit"), "unit").when(blank("note"), "note").when(F.col("paise").isNull(), "not exact")
    rows = corrections.withColumn("paise", paise).withColumn("problem", problem)
    failed = rows.groupBy(F.col(batch).alias("_batch")).agg(F.count("problem").alias("_problems"))
    return rows.join(failed, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("taken", F.col("_problems") == 0).drop("_batch", "_problems")


def queue(facts: DataFrame, kind: str | None = None, document: int | None = None, units: DataFrame | None = None, least_confidence: float | None = None, ids: list[int] | None = None, limit: int = QUEUE) -> DataFrame:
    """The first undecided facts in the order of their documents and pages, under the filters given.

    units: (admin_unit_id) whose facts are asked for, such as a state's own and all below it.
    """
    rows = facts.where("verification_status = 'unverified'")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if document is not None:
        rows = rows.where(F.col("document_id") == document)
    if units is not None:
        rows = rows.join(units.select("admin_unit_id"), "admin_unit_id", "left_semi")
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    if least_confidence is not None:
        rows = rows.where(F.col("confidence") >= least_confidence)
    return rows.orderBy("document_id", "page_number", "id").limit(limit)


def prior_decisions(history: DataFrame, fact: int) -> DataFrame:
    """A fact's replaced decisions, newest first."""
    return history.where(F.col("fact_id") == fact).orderBy(F.desc("superseded_at"), F.desc("id"))
