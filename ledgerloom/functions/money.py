"""Exact money: whole paise in decimal(38,0), never a float; what can't be read exactly is refused, not rounded.

Parsers return a struct(paise, refusal): a refused figure is a null value with a reason, and an absent one
is null in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAISE = "decimal(38,0)"
RUPEES = "decimal(20,2)"

# Marks that a source prints for "no figure", and decimal places from a unit to paise.
ABSENT = ("", "-", "--", "---", "NA", "N/A", "null", "NULL")
SHIFTS = {"thousands": 5, "crores": 9}
UNIT_SHIFTS = {
    "thousand": 5, "हजार": 5, "lakh": 7, "लाख": 7, "crore": 9,
    "कोट": 9, "कोटी": 9, "कोटि": 9, "िोट": 9, "िोटी": 9, "िोटि": 9, "ोट": 9, "ोटी": 9, "ोटि": 9,
}
RUPEES_SHIFT = 2
#: Digits that a decimal(38,0) holds.
_MOST_DIGITS = 38


def shifted_to_paise(raw: Column, shift: Column | int) -> Column:
    """struct(paise, refusal): the figure times ten to the shift, exact; commas are grouping."""
    shift = F.lit(shift) if isinstance(shift, int) else shift

    def read(p: Column) -> Column:
        """p: text, and whether it is a figure; a bound name, so that the text is made and matched once."""
        text, absent = p["text"], p["text"].isNull() | F.upper(p["text"]).isin(*{a.upper() for a in ABSENT})
        fraction = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
        digits = F.concat_ws("", F.substring_index(text, ".", 1), F.rpad(fraction, shift, "0"))  # concat works its type out anew for every value here
        fine, long = F.length(fraction) <= shift, F.length(F.ltrim(F.ltrim(digits, F.lit("-")), F.lit("0"))) > _MOST_DIGITS
        refusal = F.when(absent, None).when(~p["figure"], "not an amount").when(~fine, "sub-paise precision").when(long, "too many digits")
        paise = F.when(~absent & p["figure"] & fine & ~long, digits.try_cast(PAISE))
        known = F.struct(digits.try_cast(PAISE).alias("paise"), F.lit(None).cast("string").alias("refusal"))
        # most figures are read by this alone; the rest is worked out for those that may be refused
        return F.when(p["figure"] & fine & (F.length(text) + shift <= _MOST_DIGITS), known).otherwise(F.struct(paise.alias("paise"), refusal.alias("refusal")))

    plain = F.transform(F.array(F.replace(F.trim(raw), F.lit(","), F.lit(""))), lambda t: F.struct(t.alias("text"), t.rlike(r"^-?[0-9]+(\.[0-9]+)?$").alias("figure")))
    return F.element_at(F.transform(plain, read), 1)


def published_to_paise(raw: Column, unit: str) -> Column:
    """A figure of a report that declares its unit: thousands or crores."""
    return shifted_to_paise(raw, SHIFTS[unit])


def unit_shift(unit: Column) -> Column:
    """Places from a unit word to paise; null for a word that is no unit."""
    table = F.create_map(*[F.lit(x) for kv in UNIT_SHIFTS.items() for x in kv])
    return F.try_element_at(table, F.lower(unit))


def amount_to_paise(digits: Column, unit: Column, bare_is_rupees: bool = False) -> Column:
    """Paise of a printed amount with a unit word; a bare figure is refused unless the caller says that it is rupees."""
    bare = unit.isNull() | (unit == "")
    shift = F.when(bare, F.lit(RUPEES_SHIFT if bare_is_rupees else None).cast("int")).otherwise(unit_shift(unit))
    compact = F.regexp_replace(digits, r"(?U)\s+", "")
    return F.when(shift.isNotNull(), shifted_to_paise(compact, F.coalesce(shift, F.lit(0)))["paise"])


def rupees_to_paise(text: Column) -> Column:
    """Rupees as a page prints them, with mark, commas and spaces; at most two decimals."""
    plain = F.regexp_replace(text, r"(?U)[,₹\s]", "")
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$"), shifted_to_paise(plain, RUPEES_SHIFT)["paise"])


def printed_rupees_to_paise(printed: Column) -> Column:
    """Rupees with Indian or Western grouping, which must be right: 1,23,456.00 or 123,456."""
    text = F.trim(printed)
    grouped = text.rlike(r"^([0-9]{1,2}(,[0-9]{2})*,[0-9]{3}|[0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]{1,2})?$")
    return F.when(grouped, shifted_to_paise(text, RUPEES_SHIFT)["paise"])


def parse_decimal(text: Column) -> Column:
    """Paise of a strict decimal string as an API delivers it; anything else is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^-?[0-9]+(\.[0-9]{1,2})?$"), shifted_to_paise(trimmed, RUPEES_SHIFT)["paise"])


def to_rupees(paise: Column) -> Column:
    """Paise as rupees with two places, cast back because multiplying widens the precision."""
    return (paise.cast(PAISE) * F.lit("0.01").cast("decimal(3,2)")).cast(RUPEES)


def paise_text_to_rupees(text: Column) -> Column:
    """Rupees of stored paise text; what isn't a whole number is null."""
    return F.when(text.rlike(r"^-?[0-9]+$"), to_rupees(text.try_cast(PAISE)))


def minus(a: Column, b: Column) -> Column:
    """Exact difference of amounts; null if either is missing."""
    return (a.cast(RUPEES) - b.cast(RUPEES)).cast("decimal(21,2)")


def _parts(paise: Column) -> tuple[Column, Column, Column]:
    whole = F.abs(paise.cast(PAISE))
    sign = F.when(paise < 0, "-").otherwise("")
    rupees = F.floor(whole / F.lit(100).cast("decimal(3,0)")).cast("decimal(36,0)")
    return sign, rupees, (whole % F.lit(100)).cast("int")


def decimal_string(paise: Column) -> Column:
    """Two places, with sign: -5.25."""
    sign, rupees, rest = _parts(paise)
    return F.concat(sign, rupees.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 2, "0"))


def group_indian(digits: Column) -> Column:
    """The last three digits, then groups of two: 8,00,00,000."""
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"\B(?=([0-9]{2})+(?![0-9]))", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat_ws(",", head, F.right(digits, F.lit(3))))


def format_money(paise: Column, style: str = "crore-lakh") -> Column:
    """₹ with crore or lakh to two truncated places, or in full."""
    sign, rupees, _ = _parts(paise)

    def scaled(unit: int, word: str) -> Column:
        whole = F.floor(rupees / F.lit(unit)).cast("decimal(30,0)")
        rest = F.floor((rupees % F.lit(unit)) * 100 / F.lit(unit)).cast("int")
        return F.concat(sign, F.lit("₹"), group_indian(whole.cast("string")), F.lit("."), F.lpad(rest.cast("string"), 2, "0"), F.lit(f" {word}"))

    full = F.concat(sign, F.lit("₹"), group_indian(rupees.cast("string")))
    if style == "full":
        return full
    return F.when(rupees >= 10_000_000, scaled(10_000_000, "crore")).when(rupees >= 100_000, scaled(100_000, "lakh")).otherwise(full)


def accessible_string(paise: Column) -> Column:
    """What a screen reader says: minus 1.00 crore rupees."""
    spoken = F.replace(format_money(paise), F.lit("₹"), F.lit(""))
    return F.concat(F.regexp_replace(F.trim(spoken), "^-", "minus "), F.lit(" rupees"))


def fee_as_printed(text: Column) -> Column:
    """A bare number gets the mark; other wording stays."""
    return F.when(text.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$"), F.concat(F.lit("₹"), text)).otherwise(text)


def scaled_confidence(base: Column, weakest_word: Column) -> Column:
    """Base confidence times the weakest word's, to three places, in decimals."""
    return F.round(base.cast("decimal(4,3)") * weakest_word.cast("decimal(4,3)"), 3).cast("decimal(4,3)")


def _bands(value: Column, bounds: list[tuple[float, str]], top: str) -> Column:
    found = None
    for bound, label in bounds:
        found = F.when(value < bound, label) if found is None else found.when(value < bound, label)
    return found.otherwise(top)


def latency_bucket(milliseconds: Column) -> Column:
    v = milliseconds.cast("double")
    odd = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    return F.when(odd, "8s+").otherwise(_bands(v, [(300, "<300ms"), (1000, "<1s"), (3000, "<3s"), (8000, "<8s")], "8s+"))


def count_bucket(value: Column) -> Column:
    v = value.cast("double")
    odd = v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))
    return F.when(odd, "0").when(v <= 3, "1-3").when(v <= 10, "4-10").when(v <= 50, "11-50").otherwise("51+")


def byte_bucket(value: Column) -> Column:
    v = value.cast("double")
    odd = v.isNull() | F.isnan(v) | (v == float("inf"))
    return F.when(odd, "<100KB").otherwise(_bands(v, [(1e5, "<100KB"), (1e6, "<1MB"), (1e7, "<10MB")], "10MB+"))


def judge_budget(value: Column, target: Column, ceiling: Column) -> Column:
    return F.when(value > ceiling, "over-ceiling").when(value > target, "over-target").otherwise("within")
