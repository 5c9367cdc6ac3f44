"""Facts of whole pages: cleaned text with moved spans, candidates with their places, and figures whose scale can't be told.

The search for spans is one small Python function over Arrow batches, because Spark's regular expressions give no
offsets; reading, refusing and weighing what was found are Column functions. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import facts, markup, money, page_geometry, text
from ledgerloom.operators.reconcile import first_of_each
from ledgerloom.session import cut

# Characters that stored text can't hold, and what makes the scale of a bare figure unusable.
UNSTORABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
UNREADABLE_UNIT = r"(?iuU)^\s*(?:core|cores|crores|cr|crs|lac|lacs|lakhs|thousands|million|millions|billion|billions|mn|bn|करोड|कोटय|ोटय)\b"
UNREADABLE_SCRIPT = r"(?U)^\s*(?![A-Za-z]|\p{IsDevanagari})(?:\p{L}|\p{M})"
SPLIT_DECIMAL = r"(?iuU)^\.\s+[0-9]+\s*(?:crore|lakh|thousand|कोट|िोट|ोट|लाख|हजार)"
SCALE_OUTSIDE_BRACKET = r"(?U)^[^().।]{0,40}\)\s*(?:crore|Crore|lakh|Lakh|thousand|Thousand|कोटी|कोटि|कोट|िोटी|िोटि|िोट|ोटी|ोटि|ोट|लाख|हजार)\b"
DECLARES_RUPEES = r"(?iuU)(?:amount|amounts|amt|figures?|value|values|rupees)\.?\s+in\s*$"
#: Characters after a figure, after a figure in brackets, and before a mark that these look at.
AFTER, AFTER_BRACKET, BEFORE = 20, 60, 24

_EDGE = r"(?U)[\s\x{FEFF}]+"


def cleaned(raw: Column) -> Column:
    """struct(content, removed, lead): the text without what can't be stored and without outer white space; the ascending
    places of removed characters in the raw text; how many kept characters went at the front."""
    parts = F.split(raw, UNSTORABLE, -1)
    kept = F.array_join(parts, "")
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + F.length(p) + 1)))
    removed = F.slice(ends, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    front = F.regexp_replace(kept, "^" + _EDGE, "")
    none = F.array().cast("array<int>")
    return F.struct(F.regexp_replace(front, _EDGE + "$", "").alias("content"), F.when(F.size(parts) > 1, removed).otherwise(none).alias("removed"), (F.length(kept) - F.length(front)).alias("lead"))


def moved(place: Column, clean: Column) -> Column:
    """Where an offset into the raw text lies in the cleaned one."""
    shifted = place - F.size(F.filter(clean["removed"], lambda r: r < place)) - clean["lead"]
    return F.least(F.greatest(shifted, F.lit(0)), F.length(clean["content"])).cast("int")


def moved_items(items: Column, clean: Column) -> Column:
    """Items (char_start, char_end, x0, y0, x1, y1) with their offsets in the cleaned text; items of which nothing is left go."""
    sides = ("x0", "y0", "x1", "y1")
    out = F.transform(items, lambda i: F.struct(moved(i["char_start"], clean).alias("char_start"), moved(i["char_end"], clean).alias("char_end"), *(i[k].alias(k) for k in sides)))
    return F.filter(out, lambda i: i["char_end"] > i["char_start"])


def scale_is_unusable(sentence: Column, end: Column) -> Column:
    """Whether what follows a bare figure speaks of a scale that isn't read: an odd unit, another script, a torn decimal, a bracket."""
    after, far = F.substring(sentence, end + 1, F.lit(AFTER)), F.substring(sentence, end + 1, F.lit(AFTER_BRACKET))
    return after.rlike(UNREADABLE_UNIT) | after.rlike(UNREADABLE_SCRIPT) | after.rlike(SPLIT_DECIMAL) | far.rlike(SCALE_OUTSIDE_BRACKET)


_KINDS = (
    ("amount", text.AMOUNT), ("decoded_amount", text.AMOUNT_SUBSTITUTED), ("contractor_reference", facts.CONTRACTOR),
    ("officer_role_reference", facts.OFFICER), ("department", facts.DEPARTMENT), ("government", facts.GOVERNMENT),
)
_FOUND = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("sentence", T.StringType()), ("at", T.IntegerType()), ("to", T.IntegerType()), ("first", T.StringType()), ("second", T.StringType()), ("char_start", T.IntegerType()), ("char_end", T.IntegerType()))])
)


# What a sentence must hold, in part, for a pattern to match.
_HINTS = {"amount": ("₹", "Rs"), "decoded_amount": ("`", "´"), "contractor_reference": ("M/s",), "officer_role_reference": ("Engineer", "Collector", "Secretary"), "department": ("Department",), "government": ("Government",)}
_ARROW_FOUND = pa.list_(pa.struct([(n, pa.int32() if n in ("at", "to", "char_start", "char_end") else pa.string()) for n in ("kind", "sentence", "at", "to", "first", "second", "char_start", "char_end")]))
#: Characters of pages whose matches are objects at once.
CHUNK_CHARS = 1 << 20


_WHITE = re.compile(r"\s(?:\s+|(?<! ))")


def _sentences(flat: str, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    """The places of a flat text's sentences; a break is looked for where a full stop and a space stand."""
    cursor, at = 0, flat.find(". ")
    while at >= 0:
        m = breaks.match(flat, at)
        if m:
            yield cursor, at
            cursor = m.end()
        at = flat.find(". ", m.end() if m else at + 1)
    yield cursor, len(flat)


def _matches(page: str, patterns: list, breaks: re.Pattern) -> list[dict]:
    out: list[dict] = []
    # where white space becomes one space, in the flat text, and how many characters are gone after it
    places, gone, flat, end = [], [0], [], 0
    for m in _WHITE.finditer(page):
        start, after = m.span()
        flat += (page[end:start], " ")
        places.append(start - gone[-1])
        gone.append(gone[-1] + after - start - 1)
        end = after
    flat = "".join([*flat, page[end:]])
    source = lambda at: at + gone[bisect_left(places, at)]
    live = [(kind, pattern, h) for kind, pattern in patterns for h in [[h for h in _HINTS[kind] if h in flat]] if h]
    if not live:
        return out
    for start, end in _sentences(flat, breaks):
        sentence = flat[start:end].strip()
        lead = flat.find(sentence, start)
        for kind, pattern, hints in live if sentence else ():
            for h in hints:
                if h in sentence:
                    break
            else:
                continue
            for x in pattern.finditer(sentence):
                a, b = x.span()
                if b > a:
                    groups = (*x.groups(), None)
                    out.append({"kind": kind, "sentence": sentence, "at": a, "to": b, "first": groups[0], "second": groups[1], "char_start": source(lead + a), "char_end": source(lead + b - 1) + 1})
    return out


@F.arrow_udf(_FOUND)
def located_matches(pages: pa.Array) -> pa.Array:
    """All pattern matches in a page's sentences: their place in the sentence and, white space undone, in the page."""
    patterns = [(kind, re.compile(p.replace("(?U)", ""))) for kind, p in _KINDS]
    breaks = re.compile(text.SENTENCE_BREAK)
    done, chunk, chars = [], [], 0
    for page in pages:
        one = page.as_py() or ""
        chunk.append(_matches(one, patterns, breaks))
        chars += len(one)
        if chars >= CHUNK_CHARS:
            done.append(pa.array(chunk, _ARROW_FOUND))
            chunk, chars = [], 0
    return pa.concat_arrays([*done, pa.array(chunk, _ARROW_FOUND)])


def candidates(pages: DataFrame, document: str = "document_id", page: str = "page_number", raw: str = "content", items: str | None = None) -> DataFrame:
    """One row a candidate: document, page, kind, raw_text, normalised_value, confidence, char_start and char_end in the
    cleaned page, and its box where the pages have items.

    An amount after a column's heading ("amount in ₹") is none. A bare figure is refused on a page that declares a unit and
    where its scale is unusable. Bodies are proposed once a document, at the first page that names them.
    """
    rows = markup.bound(pages, [document, page, *([items] if items else [])], _clean=cleaned(F.col(raw))).withColumn("_text", F.col("_clean")["content"])
    rows = rows.select(document, page, *(["_clean", items] if items else []), text.declares_unit(F.col("_text")).alias("_declares"), text.lost_its_mark(F.col("_text")).alias("_lost"), located_matches("_text").alias("_found"))
    each = rows.withColumn("_boxes", moved_items(F.col(items), F.col("_clean"))) if items else rows
    each = each.select(document, page, *(["_boxes"] if items else []), "_declares", "_lost", F.posexplode("_found").alias("_place", "m")).select("*", "m.*").drop("m", "_found")
    amount = F.col("kind").isin("amount", "decoded_amount")
    heading = F.substring("sentence", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least(F.col("at"), F.lit(BEFORE))).rlike(DECLARES_RUPEES)
    each = each.where(~amount | (~heading & ((F.col("kind") == "amount") | F.col("_lost"))))
    bare = F.coalesce(F.col("second"), F.lit("")) == ""
    refused = bare & (F.col("_declares") | scale_is_unusable(F.col("sentence"), F.col("to")))
    paise = F.when(~refused, money.amount_to_paise(F.col("first"), F.col("second"), True)).cast("string")
    office = F.nullif(facts.name_of(F.coalesce("second", F.lit(""))), F.lit(""))
    value = (
        F.when(amount, paise).when(F.col("kind") == "contractor_reference", F.nullif(facts.name_of(F.col("first")), F.lit("")))
        .when(F.col("kind") == "officer_role_reference", F.concat_ws(", ", "first", office))
        .when(F.col("kind") == "department", facts.department_name(F.col("first"))).otherwise(F.concat(F.lit("Government of "), F.col("first")))
    )
    read = markup.bound(each, each.columns, normalised_value=value).where(amount | F.col("normalised_value").isNotNull())
    stated = F.when(~bare, 0.8).when(F.col("normalised_value").isNull(), 0.4).otherwise(0.6)
    sure = F.when(F.col("kind") == "amount", stated).when(F.col("kind") == "decoded_amount", F.when(bare, 0.3).otherwise(0.5)).when(F.col("kind") == "contractor_reference", 0.7).otherwise(0.5)
    kind = F.when(amount, "monetary_amount").when(F.col("kind").isin("department", "government"), "body_reference").otherwise(F.col("kind"))
    out = read.select(
        document, page, kind.alias("kind"), text.context_around(F.col("sentence"), F.col("at"), F.col("to")).alias("raw_text"), "normalised_value", sure.cast("decimal(4,3)").alias("confidence"),
        "char_start", "char_end", *([page_geometry.box_around(F.col("_boxes"), F.col("char_start"), F.col("char_end")).alias("box")] if items else []), "_place",
    )
    out = cut(out)  # bodies and other candidates are taken from one reading of the pages
    bodies = first_of_each(out.where("kind = 'body_reference'"), [document, "normalised_value"], F.asc(page), F.asc("_place"))
    return reduce(DataFrame.unionByName, (out.where("kind != 'body_reference'"), bodies)).drop("_place")
