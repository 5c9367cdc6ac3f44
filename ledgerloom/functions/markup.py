"""Reading tables, labels, links and options out of page markup with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money

# Named references but the ampersand's, and marks of a row's and a cell's beginning, which are no white space.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
_ROW, _CELL = "\x01", "\x02"


def decode_entities(text: Column) -> Column:
    """The listed named references and numeric ones; what is no character stays as it is; the ampersand last."""
    out, untouched = text, ~F.contains(text, F.lit("&"))
    for name, value in NAMED:
        out = F.replace(out, F.lit(name), F.lit(value))
    # a code point is its four bytes in UTF-32; surrogates and numbers beyond the last plane are no characters
    character = lambda n: F.when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    codes = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#([0-9]{1,7});"), F.lit(1)))
    out = F.aggregate(codes, out, lambda s, c: F.coalesce(F.replace(s, F.concat(F.lit("&#"), c, F.lit(";")), character(c.cast("bigint"))), s))
    hexes = F.array_distinct(F.regexp_extract_all(out, F.lit(r"&#([xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    out = F.aggregate(hexes, out, lambda s, c: F.coalesce(F.replace(s, F.concat(F.lit("&#"), c, F.lit(";")), character(F.conv(F.substring(c, 2, 6), 16, 10).cast("bigint"))), s))
    return F.when(untouched, text).otherwise(F.replace(out, F.lit("&amp;"), F.lit("&")))


def bound(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns and the new ones, each evaluated once: a generator of one row, through which no later use is substituted."""
    made = df.select(*kept, *[c.alias(f"_bound_{n}") for n, c in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_bound_{n}").alias(n) for n in columns]))))


def plain(cell: Column) -> Column:
    """A cell's text: tags go, references are decoded, white space is one space."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(cell, "<[^>]*>", " ")), r"(?U)\s+", " "))


def rows_by_split(html: Column) -> Column:
    """array<array<string>>: rows and cells by their opening tags alone, so missing closing tags do no harm.

    The whole page is cleaned at once, with a mark where a row and where a cell begins; a page that holds such a mark itself
    or a numeric reference, which could give one, is cleaned cell by cell.
    """
    odd = F.contains(html, F.lit("&#")) | F.contains(html, F.lit(_ROW)) | F.contains(html, F.lit(_CELL))
    parts = F.array(F.split(html, "(?i)<tr[^>]*>"))
    return F.element_at(F.transform(parts, lambda p: F.when(odd, _cells_by_cell(p)).otherwise(_cells_at_once(p))), 1)


def _cells_at_once(parts: Column) -> Column:
    """The cells of a page's parts, the first of which stands before any row."""
    out = F.regexp_replace(F.array_join(parts, _ROW), f"(?i)<t[dh][^>{_ROW}]*>", _CELL)
    out = F.regexp_replace(F.regexp_replace(out, f"(?i)</t[dhr][^{_ROW}{_CELL}]*", ""), f"<[^>{_ROW}{_CELL}]*>", " ")
    for name, value in (*NAMED, ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    for mark in (_ROW, _CELL):
        out = F.replace(F.replace(out, F.lit(f" {mark}"), F.lit(mark)), F.lit(f"{mark} "), F.lit(mark))
    cells = F.transform(F.filter(F.split(F.trim(out), _ROW), lambda r, i: i > 0), lambda r: F.filter(F.split(r, _CELL), lambda c, i: i > 0))
    return F.filter(cells, lambda r: F.size(r) > 0)


def _cells_by_cell(parts: Column) -> Column:
    rows = F.filter(parts, lambda r, i: i > 0)
    return F.filter(F.transform(rows, lambda r: F.transform(F.filter(F.split(r, "(?i)<t[dh][^>]*>"), lambda c, i: i > 0), lambda c: plain(F.regexp_replace(c, "(?is)</t[dhr].*$", "")))), lambda r: F.size(r) > 0)


def rows_by_pattern(html: Column) -> Column:
    """array<array<string>> of complete rows and cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain))


def labelled_values(html: Column) -> Column:
    """map<label, value>: neighbouring cells as label and value, the first of a label wins; labels of up to 48 characters."""
    pairs = F.flatten(F.transform(rows_by_pattern(html), lambda r: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)), F.lit(1)), lambda i: F.size(r) >= 2), lambda i: F.struct(F.get(r, i).alias("k"), F.get(r, i + 1).alias("v")))))
    sound = F.filter(pairs, lambda p: (p["k"] != "") & (F.length(p["k"]) <= 48) & (p["k"] != p["v"]))
    none = F.expr("cast(map() AS map<string, string>)")
    return F.aggregate(sound, none, lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


def stated_fields(html: Column) -> Column:
    """Labelled values that state something."""
    return F.map_filter(labelled_values(html), lambda k, v: ~F.upper(F.trim(v)).isin(*{a.upper() for a in money.ABSENT}))


def first_of(fields: Column, *labels: str) -> Column:
    """The first non-empty value among alternative labels."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(label)), F.lit("")) for label in labels])


def links(pages: DataFrame, html_col: str = "html", *carried: str, marker: str = "") -> DataFrame:
    """Distinct link targets of each page with their first place, references decoded."""
    hrefs = F.regexp_extract_all(html_col, F.lit("(?i)href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    each = pages.select(*carried, F.posexplode(hrefs).alias("place", "_href")).withColumn("href", decode_entities(F.col("_href"))).drop("_href")
    each = each.where(F.col("href").contains(marker)) if marker else each
    return each.groupBy(*carried, "href").agg(F.min("place").alias("place"))


def select_options(html: Column, select_id: str) -> Column:
    """array<struct(value, label)> of the options of one select element."""
    inner = F.regexp_extract(html, rf"(?is)<select[^>]*id\s*=\s*[\"']?{select_id}[\"']?[^>]*>(.*?)</select>", 1)
    values = F.regexp_extract_all(inner, F.lit("(?is)<option[^>]*value\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)(?=<option|</option|$)"), F.lit(1))
    labels = F.regexp_extract_all(inner, F.lit("(?is)<option[^>]*value\\s*=\\s*[\"']([^\"']*)[\"'][^>]*>(.*?)(?=<option|</option|$)"), F.lit(2))
    return F.transform(F.arrays_zip(values.alias("value"), labels.alias("label")), lambda o: F.struct(o["value"].alias("value"), plain(o["label"]).alias("label")))


def identity_of_href(href: Column) -> Column:
    """The sp parameter that names a tender."""
    return F.nullif(F.regexp_extract(decode_entities(href), r"[?&]sp=([^&#]*)", 1), F.lit(""))
