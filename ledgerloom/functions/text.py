"""Text functions over Columns: amounts, sentences, scripts, keys, scrubbing, routes.

Patterns are Java regular expressions kept as literals, so each is compiled once. Offsets count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import money

# How an amount is printed, and how a page says which unit its figures have.
_UNITS = "crore|Crore|lakh|Lakh|thousand|Thousand|कोटी|कोटि|कोट|िोटी|िोटि|िोट|ोटी|ोटि|ोट|लाख|हजार"
_FIGURE = r"([0-9]+(?:\s*,\s*[0-9]+)*(?:\.[0-9]+)?)"
AMOUNT = rf"(?U)(?:₹|\bRs\.?)\s*{_FIGURE}\s*({_UNITS})?"
AMOUNT_SUBSTITUTED = rf"(?U)[`´]\s*{_FIGURE}\s*({_UNITS})?"
SUBSTITUTED_MARK = r"(?U)[`´]\s?[0-9][0-9,]*(?:\.[0-9]+)?"
DECLARES_UNIT = r"(?iuU)\(\s*(?:₹|Rs\.?|amount|amounts|रक्कम)?[^)\d]{0,18}?(?:crore|lakh|thousand|कोट|िोट|ोट|लाख|हजार)[^)\d]{0,10}\)|(?:₹|\bRs\.?|amount|amounts)\s*(?:are\s+)?in\s+(?:crore|lakh|thousand)"
SENTENCE_BREAK = r"(?<!\bM/s)(?<!\bNo)(?<!\bRs)(?<![A-Z])\.\s+(?=[A-Z₹(])"
DISTRICT_WORDS = r"(?i)\b(?:district|distt?|zilla|zila|jilla|jila)\b\.?"
OFFICE_GRADE = r"(?iU)\s+(?:[bshg]\.?\s?o\.?|gpo|head office|sub office|branch office)\s*$"
SUBSTITUTED_GLYPH = r"[\x{0900}-\x{097F}][A-Za-z<>{}\[\]!@#$%^&*|~`]|[A-Za-z<>{}\[\]!@#$%^&*|~`][\x{0900}-\x{097F}]"
ENOUGH_DEVANAGARI = 20
LOST_MARKS = 2
CONTEXT_CHARS = 160
_LOCATED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_DEVANAGARI, _TAMIL, _LATIN = r"[\x{0900}-\x{097F}]", r"[\x{0B80}-\x{0BFF}]", r"\p{IsLatin}"


def amounts(text: Column, substituted: bool = False, bare_is_rupees: bool = True) -> Column:
    """array<struct(digits, unit, paise)> of all amounts in a text, in order."""
    pattern = F.lit(AMOUNT_SUBSTITUTED if substituted else AMOUNT)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("digits"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("unit"))
    return F.transform(pairs, lambda p: F.struct(p["digits"].alias("digits"), p["unit"].alias("unit"), money.amount_to_paise(p["digits"], p["unit"], bare_is_rupees).alias("paise")))


def declares_unit(page: Column) -> Column:
    return F.coalesce(page.rlike(DECLARES_UNIT), F.lit(False))


def substituted_marks(page: Column) -> Column:
    """How many amounts of a page lost their currency mark."""
    return F.regexp_count(page, F.lit(SUBSTITUTED_MARK))


def lost_its_mark(page: Column) -> Column:
    return F.coalesce(substituted_marks(page) >= LOST_MARKS, F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(page: Column) -> Column:
    """Sentences of a page with white space collapsed; abbreviations do not end one, and the full stop is dropped."""
    flat = F.regexp_replace(page, r"(?U)\s+", " ")
    parts = F.transform(F.split(flat, SENTENCE_BREAK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


@F.pandas_udf(_LOCATED)
def located_sentences(pages: pd.Series) -> pd.Series:
    """Sentences with the page offsets of their first and past-last characters."""
    import re

    breaks = re.compile(r"(?<!\bM/s)(?<!\bNo)(?<!\bRs)(?<![A-Z])\.\s+(?=[A-Z₹(])")

    def of(page: str | None) -> list[dict]:
        out, cursor = [], 0
        page = page or ""
        for m in [*breaks.finditer(page), None]:
            end = m.start() if m else len(page)
            piece = page[cursor:end]
            text = re.sub(r"\s+", " ", piece).strip()
            if text:
                lead = len(piece) - len(piece.lstrip())
                out.append({"text": text, "start": cursor + lead, "end": cursor + len(piece.rstrip())})
            cursor = m.end() if m else end
        return out

    return pages.map(of)


def context_around(text: Column, start: Column, end: Column) -> Column:
    """The text from 160 characters before a match to 160 after it, with an ellipsis at cut edges."""
    first, last = F.greatest(F.lit(0), start - CONTEXT_CHARS), F.least(F.length(text), end + CONTEXT_CHARS)
    body = F.trim(F.substring(text, first + 1, last - first))
    return F.concat(F.when(first == 0, "").otherwise("… "), body, F.when(last == F.length(text), "").otherwise(" …"))


def script_of(text: Column) -> Column:
    """latin, devanagari, tamil, mixed or none."""
    deva, tamil, latin = text.rlike(_DEVANAGARI), text.rlike(_TAMIL), text.rlike(_LATIN)
    # nested, so that a text is looked through once for each script at most
    beside = lambda others, alone: F.when(others, "mixed").otherwise(alone)
    return F.when(text.isNull(), "none").when(deva, beside(tamil | latin, "devanagari")).when(tamil, beside(latin, "tamil")).when(latin, "latin").otherwise("none")


def half_of_page(content: Column) -> Column:
    left = lambda others: F.length(F.regexp_replace(content, others, ""))  # regexp_count makes an array of all letters
    return F.when(left(r"[^\x{0900}-\x{097F}]+") > left("[^A-Za-z]+"), "devanagari").otherwise("latin")


def glyph_substitution(content: Column) -> Column:
    """Bad neighbours a Devanagari character; null where there are too few to tell."""
    n = F.regexp_count(content, F.lit(_DEVANAGARI))
    return F.when(n >= ENOUGH_DEVANAGARI, F.regexp_count(content, F.lit(SUBSTITUTED_GLYPH)) / n)


def _letters(name: Column) -> Column:
    """Lower-case letters only, with repeats collapsed to one."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]", ""), r"(.)\1+", "$1")


def place_key(name: Column) -> Column:
    """How post offices are compared: the office's grade goes, vowels stay."""
    return _letters(F.regexp_replace(name, OFFICE_GRADE, ""))


def strict_key(name: Column) -> Column:
    return _letters(F.regexp_replace(name, DISTRICT_WORDS, " "))


def district_key(name: Column) -> Column:
    """How a state's districts are compared: the district word and vowels go."""
    return F.regexp_replace(strict_key(name), "[aeiou]", "")


def office_of(chain: Column) -> Column:
    """The last segment of an organisation chain."""
    return F.try_element_at(chain_segments(chain), F.lit(-1))


def chain_segments(chain: Column) -> Column:
    return F.filter(F.transform(F.split(chain, r"\|\|"), lambda s: F.trim(s)), lambda s: s != "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def escape_like(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\%_])", r"\\$1")


def optional_text(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(F.upper(trimmed).isin(*{a.upper() for a in money.ABSENT}), None).otherwise(trimmed)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


# What a log line may not show.
_URL_CREDENTIALS = r"(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@]+):[^\s@]+@"
_BEARER = r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}"
_INLINE_SECRET = r"(?i)\b((?:[A-Za-z0-9]+[_-])*(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|authorization|auth))\s*[=:]\s*(\"[^\"]*\"|'[^']*'|[^\s,;)&]+)"


def scrub_secrets(value: Column) -> Column:
    """Passwords in URLs, bearer tokens and inline secrets replaced; hosts and names stay."""
    out = F.regexp_replace(value, _URL_CREDENTIALS, "$1:[redacted]@")
    return F.regexp_replace(F.regexp_replace(out, _BEARER, "$1 [redacted]"), _INLINE_SECRET, "$1=[redacted]")


def redact_context(context: Column, keys: tuple[str, ...]) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(context, lambda k, v: F.when(F.lower(k).isin(*keys), "[redacted]").otherwise(v))


def title_from_url(url: Column) -> Column:
    """The last path segment without query, extension and hash suffix, words spaced."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), r"-[0-9a-f]{8,}$", "")
    return F.trim(F.regexp_replace(plain, "[_-]+", " "))


def display_title(raw: Column) -> Column:
    """A stored title without hash, hyperlink note and language suffix; the trimmed title if nothing is left."""
    t = F.regexp_replace(F.trim(raw), r"(?i)[\s_-]+[0-9a-f]{10,}$", "")
    t = F.regexp_replace(t, r"(?i)[\s_-]*\(?hyper\s?linked\)?$", "")
    t = F.trim(F.regexp_replace(t, r"(?i)[\s_-]+(english|hindi|marathi|tamil)$", ""))
    return F.when(t == "", F.trim(raw)).otherwise(t)


def route_pattern(path: Column, templates: dict[str, str]) -> Column:
    """The first template whose pattern the whole path matches, or other."""
    found = F.lit("other")
    for pattern, name in reversed(list(templates.items())):
        found = F.when(path.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found
