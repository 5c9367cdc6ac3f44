"""Rows and cells of a page's tables with the classes that name their columns, by one pass of an element stack over a page.

Most pages hold plain tags only, and these repeat: such a page is split at its tags, and each distinct tag is parsed once and
remembered. Any other page is parsed as a whole, by a stack of the same rules.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

_TEXTS = ArrayType(StringType())
CELL = StructType().add("head", BooleanType()).add("classes", _TEXTS).add("text", StringType()).add("links", _TEXTS)
ROW = StructType().add("place", IntegerType()).add("styles", _TEXTS).add("body", BooleanType()).add("cells", ArrayType(CELL))
STRUCTURE = StructType().add("rows", ArrayType(ROW)).add("links", _TEXTS)
_ARROW_CELL = pa.struct([("head", pa.bool_()), ("classes", pa.list_(pa.string())), ("text", pa.string()), ("links", pa.list_(pa.string()))])
_ARROW_ROW = pa.struct([("place", pa.int32()), ("styles", pa.list_(pa.string())), ("body", pa.bool_()), ("cells", pa.list_(_ARROW_CELL))])
_ARROW = pa.struct([("rows", pa.list_(_ARROW_ROW)), ("links", pa.list_(pa.string()))])

#: Pages in an Arrow batch, characters of pages that are objects at once, and distinct tags that a worker remembers.
BATCH_PAGES, CHUNK_CHARS, REMEMBERED_TAGS = 1000, 1 << 20, 10_000
#: A tag of a known element, whose attributes have values that can't hide its end, or a comment without marks in it.
_PLAIN_TAG = re.compile(
    r"""(<(?:table|thead|tbody|tfoot|tr|td|th|a|b|i|u|em|strong|ul|ol|li|p|br|div|span)(?:[ \n]+[a-z-]+=(?:"[^"]*"|'[^']*'|[A-Za-z0-9_./-]*[A-Za-z0-9_.-](?=[ \n>])))*[ \n]*>"""
    r"""|</(?:table|thead|tbody|tfoot|tr|td|th|a|b|i|u|em|strong|ul|ol|li|p|div|span)>|<!--[A-Za-z0-9 ]*-->)"""
)


class _Tables(HTMLParser):
    """Text belongs to every open cell, a cell to the innermost open table; a row or cell ends where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.links, self.open, self.tables, self.raw = [], [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        top = self.open[-1] if self.open else None
        if tag == "table":
            self.open.append({"place": self.tables, "styles": (a.get("class") or "").split(), "body": False, "row": None, "cell": None})
            self.tables += 1
        elif tag in ("script", "style"):
            self.raw += 1
        elif tag == "a" and a.get("href") is not None:
            self.links.append(a["href"])
            for t in self.open:
                if t["cell"]:
                    t["cell"]["links"].append(a["href"])
        elif top and tag in ("thead", "tbody", "tfoot", "tr"):
            top["row"] = top["cell"] = None
            if tag == "tr":
                top["row"] = {"place": top["place"], "styles": top["styles"], "body": top["body"], "cells": []}
                self.rows.append(top["row"])
            else:
                top["body"] = tag == "tbody"
        elif top and top["row"] and tag in ("td", "th"):
            top["cell"] = {"head": tag == "th", "classes": (a.get("class") or "").split(), "text": [], "links": []}
            top["row"]["cells"].append(top["cell"])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = max(0, self.raw - 1)
        elif self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("tr", "thead", "tbody", "tfoot"):
            self.open[-1].update({"row": None, "cell": None} | ({} if tag == "tr" else {"body": False}))
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cell"] = None

    def handle_data(self, data):
        for t in self.open:
            if t["cell"] and not self.raw:
                t["cell"]["text"].append(data)


class _Tag(HTMLParser):
    """What one plain tag does to a page's stack: the step's number, what it carries, and the classes that it names."""

    step = (0, None, None)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag in ("td", "th"):
            self.step = (1, tag == "th", classes)
        elif tag == "a" and a.get("href") is not None:
            self.step = (2, a["href"], None)
        elif tag == "tr":
            self.step = (3, None, None)
        elif tag in ("thead", "tbody", "tfoot"):
            self.step = (4, tag == "tbody", None)
        elif tag == "table":
            self.step = (5, None, classes)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.step = (6, None, None)
        elif tag in ("tr", "thead", "tbody", "tfoot"):
            self.step = (7, tag != "tr", None)
        elif tag == "table":
            self.step = (8, None, None)


_steps: dict[str, tuple] = {}
#: A link with nothing but its target, in which no reference is to be decoded: most are met once, so they aren't worth a parser nor a place in memory.
_LINK = re.compile(r'<a[ ]href="([^"&\x00]*)">')
#: What a page's outline has of a data cell.
_DATA_CELL = {"head": False, "classes": None, "text": None, "links": None}


def _step(tag: str) -> tuple:
    link = _LINK.fullmatch(tag)
    if link:
        return 2, link[1], None
    if len(_steps) >= REMEMBERED_TAGS:
        _steps.clear()
    one = _Tag(convert_charrefs=True)
    one.feed(tag)
    _steps[tag] = one.step
    return one.step


def _plain(parts: list[str], outline: bool = False) -> tuple[list, list]:
    """Rows and links of a page of plain tags, as _Tables reads them: texts at even places, tags at odd ones. An outline has no texts of data cells."""
    rows, links, stack, tables, known = [], [], [], 0, _steps.get
    top = None
    for i, part in enumerate(parts):
        if not i & 1:
            if part and stack:
                text = unescape(part) if "&" in part else part
                for t in stack:
                    if t["cell"]:
                        t["cell"]["text"].append(text)
            continue
        if outline and part.startswith("<a"):
            continue
        kind, held, classes = known(part) or _step(part)
        if kind == 1:
            row = top and top["row"]
            if row and outline and not held:
                top["cell"] = None
                row["cells"].append(_DATA_CELL)
            elif row:
                cell = top["cell"] = {"head": held, "classes": classes, "text": [], "links": []}
                row["cells"].append(cell)
        elif kind == 2:
            links.append(held)
            for t in stack:
                if t["cell"]:
                    t["cell"]["links"].append(held)
        elif kind == 5:
            top = {"place": tables, "styles": classes, "body": False, "row": None, "cell": None}
            stack.append(top)
            tables += 1
        elif kind and top:
            if kind == 3:
                top["cell"] = None
                top["row"] = {"place": top["place"], "styles": top["styles"], "body": top["body"], "cells": []}
                rows.append(top["row"])
            elif kind == 4:
                top["row"] = top["cell"] = None
                top["body"] = held
            elif kind == 6:
                top["cell"] = None
            elif kind == 7:
                top["row"] = top["cell"] = None
                if held:
                    top["body"] = False
            else:
                stack.pop()
                top = stack[-1] if stack else None
    return rows, links


def _read(html: str | None, outline: bool = False) -> tuple[list, list]:
    parts = _PLAIN_TAG.split(html or "")
    if any("<" in t for t in parts[::2]):
        page = _Tables()
        page.feed(html)
        page.close()
        rows, links = page.rows, page.links
    else:
        rows, links = _plain(parts, outline)
    for row in rows:
        for cell in row["cells"]:
            if cell is _DATA_CELL:
                continue
            text = cell["text"]
            text = " ".join((text[0] if len(text) == 1 else "".join(text)).split())
            cell["text"] = text if text.isascii() else unicodedata.normalize("NFC", text)
    return rows, links


@F.arrow_udf(STRUCTURE)
def structure(html: pa.Array) -> pa.Array:
    """struct(rows, links) of each page: rows in page order with their table's place and classes, and all link targets.

    Comments, scripts and styles are no text; white space is one space; text is in NFC. A null page has neither rows nor links.
    Only CHUNK_CHARS of pages at a time are Python objects.
    """
    return _structures(html, False)


@F.arrow_udf(STRUCTURE)
def outline(html: pa.Array) -> pa.Array:
    """As ``structure``, but a data cell may be a place without classes, text and links, and links may be left out: enough to tell whether a page is the known table."""
    return _structures(html, True)


def _structures(html: pa.Array, outline: bool) -> pa.Array:
    done, chunk, chars = [], [], 0
    for page in html.to_pylist():
        rows, links = _read(page, outline)
        chunk.append({"rows": rows, "links": [] if outline else links})
        chars += len(page or "")
        if chars >= CHUNK_CHARS:
            done.append(pa.array(chunk, _ARROW))
            chunk, chars = [], 0
    return pa.concat_arrays([*done, pa.array(chunk, _ARROW)])


def bounded(pages: DataFrame) -> DataFrame:
    """The pages, in a session whose Arrow batches hold BATCH_PAGES pages or fewer."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", pages.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_PAGES:
        spark.conf.set(key, str(BATCH_PAGES))
    return pages
