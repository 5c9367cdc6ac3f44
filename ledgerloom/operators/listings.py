"""Listing pages: columns named by class, columns in an exact order, a directory by its headers, and the pages of a run.

A page that isn't the known table is refused whole with its reason, so that a moved column never fills another. Each reader
takes (page_id, html) and gives a row a page: page_id, rows (array), refusal, and last_page where there is a pager.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import markup, tables
from ledgerloom.operators.actuals import MONTHS

# The classes and headers by which the known tables are told, and the cells that state no code.
CLASS_PREFIX, CLASS_TABLE = "views-field-", "views-table"
CLASS_COLUMNS = {"serial": "counter-1", "published": "field-tender-date-1", "title": "title-1", "reference": "field-tender-ref-no-1", "board": "field-board-1", "description": "field-tender-document-2", "closing": "field-tender-end-date-1"}
CLASS_NEEDED = ("published", "title", "reference", "board", "closing")
ORDERED_TABLE, ORDERED_HEADERS = "tablepress", ("sr. no", "publication date", "last date/ time of submission", "name of work", "tender notice")
DIRECTORY_HEADERS = ("State LGD Code", "State Name (In English)", "State Name (In Local language)", "State or UT")
NO_CODE = ("", "-", "NA")


def _date(text: Column, pattern: str, short: bool) -> Column:
    """The date of day, month name and year by the pattern's groups; null for another form or a day that isn't in the month."""
    name = F.lower(F.regexp_extract(text, pattern, 2))
    place = lambda names: F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0)).cast("int")
    month = F.coalesce(place(MONTHS), place([m[:3] for m in MONTHS]), F.when(name == "sept", 9)) if short else place(MONTHS)
    return F.try_to_timestamp(F.concat(F.regexp_extract(text, pattern, 3), F.lit("-"), month.cast("string"), F.lit("-"), F.regexp_extract(text, pattern, 1)), F.lit("yyyy-M-d")).cast("date")


def full_date(text: Column) -> Column:
    """30 September 2026."""
    return _date(text, r"^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})$", short=False)


def leading_date(text: Column) -> Column:
    """6 July-2026 at 12:00 PM, 20-Jun-2024: a named month; digits alone could be either way round and stay unread."""
    return _date(text, r"^([0-9]{1,2})[\s-]+([A-Za-z]+)[\s-]+([0-9]{4})\b", short=True)


def _structure(pages: DataFrame, whole: bool = True) -> DataFrame:
    read = markup.bound(tables.bounded(pages).withColumn("read", (tables.structure if whole else tables.outline)("html")), ["page_id"], read=F.col("read"))
    return read.select("page_id", "read.rows", "read.links")


def _of_table(style: str) -> Column:
    """The rows of the first table of a class; null without one."""
    first = F.get(F.filter("rows", lambda r: F.array_contains(r["styles"], style)), F.lit(0))["place"]
    return F.when(first.isNotNull(), F.filter("rows", lambda r: r["place"] == first))


def _heads(rows: Column) -> Column:
    return F.filter(F.flatten(F.transform(rows, lambda r: r["cells"])), lambda c: c["head"])


def _data(row: Column) -> Column:
    return F.filter(row["cells"], lambda c: ~c["head"])


def by_class(pages: DataFrame, origin: str, whole: bool = True) -> DataFrame:
    """Columns by class. Refusals: no_table (none of the class with a row), missing_columns, no_rows. Links to PDFs become absolute and distinct.

    Not whole: for the refusals alone, rows stay unread.
    """
    read = _structure(pages, whole)
    pages_named = F.transform("links", lambda h: F.nullif(F.regexp_extract(h, r"[?&]page=([0-9]+)", 1), F.lit("")).try_cast("int"))
    read = markup.bound(read, ["page_id"], rows=_of_table(CLASS_TABLE), last_page=F.array_max(pages_named))
    held = F.flatten(F.transform(_heads(F.col("rows")), lambda c: c["classes"]))

    def absolute(href: Column) -> Column:
        return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.lit(origin + "/"), F.ltrim(href, F.lit("/"))))

    def listed(row: Column) -> Column:
        text = lambda c: F.coalesce(F.get(F.filter(_data(row), lambda x: F.array_contains(x["classes"], CLASS_PREFIX + c)), F.lit(0))["text"], F.lit(""))
        links = F.filter(F.flatten(F.transform(row["cells"], lambda c: c["links"])), lambda h: h.rlike(r"(?i)\.pdf($|\?)"))
        return F.struct(*[text(c).alias(n) for n, c in CLASS_COLUMNS.items()], F.array_distinct(F.transform(links, absolute)).alias("documents"))

    body = F.filter("rows", lambda r: r["body"])
    body = F.transform(body, listed) if whole else body
    read = markup.bound(read, ["page_id", "last_page"], table=F.col("rows").isNotNull(), missing=F.size(F.array_except(F.array(*[F.lit(CLASS_PREFIX + CLASS_COLUMNS[n]) for n in CLASS_NEEDED]), held)), rows=body)
    refusal = F.when(~F.col("table"), "no_table").when(F.col("missing") > 0, "missing_columns").when(F.size("rows") == 0, "no_rows")
    return markup.bound(read, ["page_id", "last_page", "rows"], refusal=refusal)


def by_headers(pages: DataFrame, whole: bool = True) -> DataFrame:
    """Columns by place, trusted only if the first five headers are the known ones. Refusals: no_table, unexpected_columns, no_rows. Not whole: for these alone."""
    read = markup.bound(_structure(pages, whole), ["page_id"], rows=_of_table(ORDERED_TABLE))
    heads = F.slice(F.transform(_heads(F.col("rows")), lambda c: F.lower(c["text"])), 1, len(ORDERED_HEADERS))

    def listed(row: Column) -> Column:
        cell = lambda i: F.get(_data(row), F.lit(i))
        links = F.filter(F.transform(cell(4)["links"], lambda h: F.trim(h)), lambda h: h.rlike(r"""(?i)^https?://[^\s<>"]+\.pdf(\?[^\s<>"]*)?$"""))
        return F.struct(*[cell(i)["text"].alias(n) for i, n in enumerate(("serial", "published", "closing", "title"))], F.array_distinct(links).alias("documents"))

    body = F.filter("rows", lambda r: F.size(_data(r)) >= len(ORDERED_HEADERS))
    body = F.transform(body, listed) if whole else body
    read = markup.bound(read, ["page_id"], table=F.col("rows").isNotNull(), known=heads == F.array(*[F.lit(h) for h in ORDERED_HEADERS]), rows=body)
    refusal = F.when(~F.col("table"), "no_table").when(~F.col("known"), "unexpected_columns").when(F.size("rows") == 0, "no_rows")
    return markup.bound(read, ["page_id", "rows"], refusal=refusal)


def directory(pages: DataFrame) -> DataFrame:
    """A directory of units: rows of seven cells or more that begin with a number.

    Refusals, the first that holds: missing_columns, code_not_numeric, no_name, kind_unknown, no_rows, code_twice. A local
    name is one only in another script than Latin and unlike the English name; an empty cell, "-" and "NA" are no code.
    """
    read = _structure(pages)
    heads = F.transform(_heads(F.col("rows")), lambda c: c["text"])

    def unit(row: Column) -> Column:
        text = lambda i: F.get(_data(row), F.lit(i))["text"]
        foreign = text(3).rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]") & (F.upper(text(3)) != F.upper(text(2)))
        code = lambda i: F.when(~F.upper(text(i)).isin(*NO_CODE), text(i))
        return F.struct(text(1).alias("code"), text(2).alias("name_en"), F.when(foreign, text(3)).alias("name_local"), F.upper(text(4)).alias("kind"), code(5).alias("census_2001"), code(6).alias("census_2011"))

    data = F.filter("rows", lambda r: (F.size(_data(r)) >= 7) & F.get(_data(r), F.lit(0))["text"].rlike("^[0-9]+$"))
    read = markup.bound(read, ["page_id"], missing=F.size(F.array_except(F.array(*[F.lit(h) for h in DIRECTORY_HEADERS]), heads)), rows=F.transform(data, unit))
    refusal = (
        F.when(F.col("missing") > 0, "missing_columns")
        .when(F.exists("rows", lambda u: ~u["code"].rlike("^[0-9]+$")), "code_not_numeric")
        .when(F.exists("rows", lambda u: u["name_en"] == ""), "no_name")
        .when(F.exists("rows", lambda u: ~u["kind"].isin("STATE", "UT")), "kind_unknown")
        .when(F.size("rows") == 0, "no_rows")
        .when(F.size(F.array_distinct(F.transform("rows", lambda u: u["code"]))) < F.size("rows"), "code_twice")
    )
    return markup.bound(read, ["page_id", "rows"], refusal=refusal)


def rows(read: DataFrame) -> DataFrame:
    """A row a listed row of the pages that aren't refused, with its place on the page from 0."""
    kept = [c for c in read.columns if c not in ("rows", "refusal")]
    return read.where("refusal IS NULL").select(*kept, F.posexplode("rows").alias("place", "row")).select(*kept, "place", "row.*")


def refusals(read: DataFrame) -> DataFrame:
    return read.where("refusal IS NOT NULL").select("page_id", "refusal")


def collect(listed: DataFrame, held: DataFrame) -> DataFrame:
    """What a run takes from listed documents (agency, page, url) beyond the held ones (url): pages, listed, fetched, already_held.

    A run goes through an agency's pages in order and stops after the first page that has nothing new: no document that isn't
    held and wasn't listed by an earlier page. Newness is a left join and a minimum, the stop a minimum, so no page waits for another.
    """
    known = held.select("url").distinct().withColumn("is_held", F.lit(True))
    firsts = listed.groupBy("agency", "url", "page").agg(F.count("*").alias("n"))
    new_on = firsts.groupBy("agency", "url").agg(F.min("page").alias("page")).join(known, "url", "left").where("is_held IS NULL").groupBy("agency", "page").agg(F.count("*").alias("fetched"))
    pages = firsts.groupBy("agency", "page").agg(F.sum("n").alias("listed")).join(new_on, ["agency", "page"], "left").fillna(0, ["fetched"])
    stops = pages.groupBy("agency").agg(F.min(F.when(F.col("fetched") == 0, F.col("page"))).alias("stop"))
    read = pages.join(stops, "agency").where("stop IS NULL OR page <= stop")
    return read.groupBy("agency").agg(F.count("*").alias("pages"), F.sum("listed").alias("listed"), F.sum("fetched").alias("fetched"), F.sum(F.col("listed") - F.col("fetched")).alias("already_held"))
