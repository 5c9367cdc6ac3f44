"""Operator 9: personal data by patterns, checksum validators and context words.

Patterns propose spans, validators (Luhn for cards, mod-97 for bank account numbers, value ranges for
addresses and digit counts for phones, entropy for secrets) confirm them, and words near a span raise or
lower its score. The four base kinds are kept whatever their score; the further kinds need MIN_SCORE.

Defined cases: a null text is the empty text and has no spans; empty tables give empty tables;
repeated rows give a row each; a null id stays null; spans of different kinds may overlap, those of one kind
never; very long texts and digit runs are read whole, in linear time; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches

#: Kinds in the order of the result's span list; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: The score that a span of a further kind needs.
MIN_SCORE = 0.6
#: Code points on either side of a span in which context words count.
CONTEXT = 40

_EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A digit run either matches from its first digit or not at all, so starts inside a run are passed over.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_+/-]{20,}={0,2}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile("[0-9]")

#: Context words that raise the score of a kind, and words that lower any score.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "api key", "apikey", "credential", "bearer", "authorization", "private key"),
}
#: The length of an account number by its country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
DOUBT_WORDS = ("version", "isbn", "serial", "order no", "invoice")
#: Scores before context; a checksum weighs more than a shape.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}


def luhn(digits: str) -> bool:
    """The card checksum: from the right, every second digit doubled, digit sums divisible by ten."""
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The bank account checksum: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs of letters cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_NAME:
            start -= 1
        found = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", found.end() if found else at + 1)
        free = max(free, 0)


def _small(number: str) -> bool:
    number = number.lstrip("0")  # int() refuses very long strings, zeros or not
    return len(number) <= 3 and int(number or "0") <= 255


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: from each country and check digits, as many characters as the country has, single spaces between."""
    free = 0
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[1])
        if length is None or m.start() < free:
            continue
        account, end = m[0], m.end()
        while len(account) < length and end < len(text):
            at = end + (text[end] == " ")
            if at >= len(text) or not (text[at].isascii() and (text[at].isdigit() or text[at].isupper())):
                break
            account, end = account + text[at], at + 1
        whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
        if len(account) == length and whole and mod97(account):
            yield m.start(), end
            free = end


def _is_secret(word: str) -> bool:
    """Letters and digits mixed as by chance: both kinds, and at least 3 bits of entropy a character."""
    digits = sum(c.isdigit() for c in word)
    if not 3 <= digits < len(word.rstrip("=")) - 2:
        return False
    counts = [n / len(word) for n in Counter(word).values()]
    return -sum(p * math.log2(p) for p in counts) >= 3.0


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind: kind, start, end."""
    for start, end in _emails(text):
        yield "email", start, end
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(map(_small, m[0].split("."))):
                    yield "ip", *m.span()
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    yield "card", *m.span()
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    yield "phone", *m.span()
        for span in _accounts(text):
            yield "iban", *span
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield "ssn", *m.span()
        for m in _SECRET.finditer(text):
            if _is_secret(m[0]):
                yield "secret", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's base score, raised by a context word of the kind nearby and lowered by a doubt word."""
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    value = BASE_SCORE[kind] + 0.3 * any(w in near for w in CONTEXT_WORDS[kind]) - 0.3 * any(w in near for w in DOUBT_WORDS)
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> list[dict]:
    """Spans of one text, by kind as listed, then start."""
    spans = [{"kind": k, "start": a, "end": b, "score": score(text, k, a, b)} for k, a, b in candidates(text)]
    return [s for kind in KINDS for s in spans if s["kind"] == kind and (kind in BASE_KINDS or s["score"] >= MIN_SCORE)]


def redact(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one, under the first's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row a document: id, spans (array of kind, start, end, score) and, if asked for, the redacted text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>" + (", redacted string" if redacted else "")
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [find(t) for t in texts]
            columns = [batch.column(0), pa.array(found, item)]
            if redacted:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "spans", "redacted"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _joined(spans: str) -> F.Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans."""
    base = "filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    return find_spans(docs).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
