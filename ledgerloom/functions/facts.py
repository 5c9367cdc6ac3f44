"""Facts that a sentence states: amounts with a confidence, contractors, officers' roles, public bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text

# How firms, offices and bodies are written, and words that a body's name does not hold.
CONTRACTOR = r"\bM/s\.?\s+([A-Z][^,.;()]{2,70}?)(?=\s*[,.;()]|\s+(?:for|was|had|to)\b|$)"
OFFICER = r"\b((?:Executive|Superintending|Deputy|Chief|Junior|Sectional|Assistant)\s+Engineer|Collector|Secretary)\b(?:\s*,?\s*([A-Z][A-Za-z\s]{2,44}?))?(?=\s*[,.;()]|\s+(?:requested|stated|had|was|issued)\b|$)"
DEPARTMENT = r"((?:[A-Z][\w’'&-]*[,]?\s+(?:(?:and|&)\s+)?)+)Department\b"
GOVERNMENT = r"\bGovernment\s+of\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
NOT_A_NAME = (
    "a", "according", "administrative", "after", "all", "also", "an", "and", "any", "as", "at", "audit", "but", "by", "concerned", "during", "each", "every",
    "for", "from", "further", "government", "however", "if", "implementing", "in", "its", "line", "nodal", "of", "on", "other", "respective", "said", "state",
    "such", "that", "the", "their", "these", "this", "to", "under", "when", "while", "with",
)
RESTARTS = (
    "accordingly", "act", "additional", "amount", "assistant", "chief", "commissioner", "department", "departmental", "deputy", "director", "engineer",
    "executive", "funds", "general", "gom", "guidelines", "hon’ble", "hon'ble", "introduction", "joint", "level", "maharashtra", "minister", "observations",
    "officer", "principal", "report", "rule", "sample", "secretary", "similarly", "total", "under",
)
JOINERS = ("of", "&")


def name_of(captured: Column) -> Column:
    """The leading words that look like a name: stops at "and", at lower case that doesn't join and at bare numbers; a trailing initial refuses it."""
    words = F.filter(F.split(F.trim(captured), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "[,.;:]+$", ""))
    ends = lambda w: (w == "") | (F.lower(w) == "and") | (w.rlike("[0-9]") & ~w.rlike("^[A-Z][A-Z0-9-]*$")) | (w.rlike("^[a-z]") & ~F.lower(w).isin(*JOINERS))
    first_end = F.array_position(F.transform(bare, ends), True)
    kept = F.when(first_end > 0, F.slice(bare, 1, first_end.cast("int") - 1)).otherwise(bare)
    joined = F.regexp_replace(F.array_join(kept, " "), r"(?:\s+(?:of|&|\S))+$", "")
    initial = (F.size(kept) > 1) & F.element_at(kept, -1).rlike("^[A-Z]$")
    return F.when((F.size(kept) == 0) | initial, "").otherwise(F.when(F.length(joined) > 1, joined).otherwise(""))


def contractors(sentence: Column) -> Column:
    """Firms marked by M/s."""
    return F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(CONTRACTOR), F.lit(1)), name_of), lambda n: n != "")


def officers(sentence: Column) -> Column:
    """Roles with their office where it is stated."""
    pairs = F.arrays_zip(F.regexp_extract_all(sentence, F.lit(OFFICER), F.lit(1)).alias("role"), F.regexp_extract_all(sentence, F.lit(OFFICER), F.lit(2)).alias("office"))
    return F.transform(pairs, lambda p: F.concat_ws(", ", p["role"], F.nullif(name_of(F.coalesce(p["office"], F.lit(""))), F.lit(""))))


def department_name(run: Column) -> Column:
    """The words after the last one that starts afresh (stop words, roles, abbreviations), without outer joiners."""
    words = F.filter(F.split(F.replace(run, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    joiner = lambda w: F.lower(w).isin("and", "&")
    afresh = lambda w: ~joiner(w) & (F.lower(w).isin(*NOT_A_NAME, *RESTARTS) | w.rlike("^[A-Z]{2,}s?$"))
    last = F.size(words) - F.array_position(F.reverse(F.transform(words, afresh)), True).cast("int") + 1
    rest = F.when(F.exists(words, afresh), F.slice(words, last + 1, F.greatest(F.size(words) - last, F.lit(0)))).otherwise(words)
    name = F.trim(F.regexp_replace(F.array_join(rest, " "), r"(?i)^(?:(?:and|&)\s+)+|(?:\s+(?:and|&))+$|^(?:and|&)$", ""))
    return F.when((name != "") & (F.lower(name) != "general"), F.concat(name, F.lit(" Department")))


def bodies(sentence: Column) -> Column:
    """Departments and governments that a sentence names."""
    departments = F.array_compact(F.transform(F.regexp_extract_all(sentence, F.lit(DEPARTMENT), F.lit(1)), department_name))
    governments = F.transform(F.regexp_extract_all(sentence, F.lit(GOVERNMENT), F.lit(1)), lambda g: F.concat(F.lit("Government of "), g))
    return F.concat(departments, governments)


def amounts(sentence: Column, page: Column) -> Column:
    """array<struct(paise, confidence)>: a bare figure is rupees unless the page declares a unit; lost marks are read only where the page shows the defect."""
    refuse = text.declares_unit(page)

    def read(substituted: bool) -> Column:
        found = text.amounts(sentence, substituted)
        stated = lambda a: F.coalesce(a["unit"], F.lit("")) != ""
        value = lambda a: F.when(stated(a) | ~refuse, a["paise"])
        high, low = (0.5, 0.3) if substituted else (0.8, None)
        sure = lambda a: F.when(stated(a), high).otherwise(F.lit(low) if low else F.when(value(a).isNull(), 0.4).otherwise(0.6))
        return F.transform(found, lambda a: F.struct(value(a).alias("paise"), sure(a).cast("decimal(4,3)").alias("confidence")))

    none = F.expr("cast(array() AS array<struct<paise: decimal(38,0), confidence: decimal(4,3)>>)")
    return F.concat(read(False), F.when(text.lost_its_mark(page), read(True)).otherwise(none))


def self_check(value: Column, evidence: Column, claimed: Column | None = None) -> Column:
    """How a stored value stands to its own evidence: no_value, mismatch, confirmed, confirmed_in_context or ambiguous."""
    found = F.filter(F.transform(F.concat(text.amounts(evidence), text.amounts(evidence, True)), lambda a: a["paise"]), lambda p: p.isNotNull())
    same = F.size(F.filter(found, lambda p: p == value))
    others = F.filter(found, lambda p: p != value) if claimed is None else F.filter(found, lambda p: (p != value) & ~F.array_contains(claimed, p))
    return F.when(value.isNull(), "no_value").when(same == 0, "mismatch").when(F.size(found) == 1, "confirmed").when(F.size(others) == 0, "confirmed_in_context").otherwise("ambiguous")


