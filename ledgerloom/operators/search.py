"""Search over places, records and pages: trigram similarity, whole words and phrases, ranks, headlines.

Publication is filtered before the limit, so a result is short only if no more may be shown.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Similarity from which a name counts as like the term, and words of an excerpt.
SIMILAR, EXCERPT_WORDS = 0.3, 28


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def _clean(term: str) -> str:
    return re.sub(r"\s+", " ", term).strip()


def places(units: DataFrame, term: str, limit: int) -> DataFrame:
    """Units whose name contains the term or is like it: prefix first, then containing, then by similarity and name."""
    name, t = F.lower("name_en"), _clean(term)
    hits = units.withColumn("score", similarity(F.col("name_en"), F.lit(t))).withColumn("contains", F.contains(name, F.lit(t.lower()))).withColumn("prefix", F.startswith(name, F.lit(t.lower())))
    hits = hits.where(F.col("contains") | (F.col("score") >= SIMILAR))
    return hits.orderBy(F.desc("prefix"), F.desc("contains"), F.desc("score"), "name_en", "id").limit(limit)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parse_query(term: str) -> tuple[list[list[str]], list[str]]:
    """Phrases that must occur (a word is a phrase of one) and words that must not: "a phrase" word -not."""
    wanted, banned = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', term):
        words = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if minus:
            banned += words
        elif words:
            wanted.append(words)
    return wanted, banned


def matches(text: Column, term: str) -> Column:
    """Whether a text has all words and phrases of the query and none of the banned words."""
    wanted, banned = parse_query(term)
    line = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    found = F.lit(bool(wanted))
    for words in wanted:
        found = found & F.contains(line, F.lit(f" {' '.join(words)} "))
    for word in banned:
        found = found & ~F.contains(line, F.lit(f" {word} "))
    return F.coalesce(found, F.lit(False))


def rank(text: Column, term: str) -> Column:
    """Occurrences of the query's words over the logarithm of the text's length: more and denser is higher."""
    words = [w for phrase in parse_query(term)[0] for w in phrase]
    hits = F.size(F.filter(tokens(text), lambda t: t.isin(*words) if words else F.lit(False)))
    return hits / (1 + F.log(F.size(tokens(text)) + 1.0))


def headline(text: Column, term: str, most: int = EXCERPT_WORDS) -> Column:
    """A window of words around the first hit."""
    words = [w for phrase in parse_query(term)[0] for w in phrase] or [""]
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.size(F.split(F.regexp_extract(F.lower(F.array_join(parts, " ")), rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}]){re.escape(words[0])}(?![\p{{L}}\p{{N}}])", 1), " "))
    start = F.greatest(at - most // 2, F.lit(1))
    return F.array_join(F.slice(parts, start, F.lit(most)), " ")


def passages(pages: DataFrame, term: str, limit: int, text: str = "text", key: str = "id") -> DataFrame:
    """The best pages first; excerpts are made for these few only."""
    ranked = pages.where(matches(F.col(text), term)).withColumn("rank", F.round(rank(F.col(text), term), 9)).orderBy(F.desc("rank"), key).limit(limit)
    return ranked.withColumn("excerpt", headline(F.col(text), term))
