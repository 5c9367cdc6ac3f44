"""Search over postings: an inverted table of tokens, built once, read by token.

Postings (token, key, places) are range-partitioned and sorted by token and key and kept as Parquet, so that a
filter on a token reads the few row groups that hold it, and a very common token spans as many files as it needs.
A query joins its tokens from the rarest on; phrases are told by places; texts are read for the shown pages only.

The rank is proximity: 1 minus the product, over all pairs of places of two different tokens of the query, of
1 - 0.1 * sqrt(nearness), with nearness falling from one to nothing at a distance of a hundred tokens; a query of
one token ranks by 0.1 / 1.64493406685 times the sum of 1 / i ** 2 over its occurrences. An excerpt is the window of
EXCERPT_WORDS tokens that holds the most of the query's tokens, the first of equals.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.search import EXCERPT_WORDS, parse_query, tokens
from ledgerloom.session import Cut

#: Tokens further apart than this add nothing to a rank.
REACH = 100
# The weight of a plain token, the two terms of nearness, and the sum of 1 / i ** 2.
_WEIGHT, _NEAR, _FAR, _ALL = 0.1, 1.005, 0.05, 1.64493406685


@dataclass
class Index:
    """Postings and how many keys each token has; both as Parquet in the shared folder."""

    postings: Cut
    sizes: Cut

    def drop(self) -> None:
        self.postings.drop()
        self.sizes.drop()


def build(pages: DataFrame, key: str = "id", text: str = "text", partitions: int | None = None) -> Index:
    """The index of all pages; null texts and null keys have no tokens."""
    placed = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.posexplode(tokens(F.col(text))).alias("place", "token"))
    listed = placed.groupBy("token", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    ranged = listed.repartitionByRange(partitions, "token", "key") if partitions else listed.repartitionByRange("token", "key")
    postings = Cut(ranged.sortWithinPartitions("token", "key"))
    sizes = Cut(postings.df.groupBy("token").agg(F.count("*").alias("keys")).repartitionByRange("token").sortWithinPartitions("token"))
    return Index(postings, sizes)


@F.pandas_udf(T.DoubleType())
def proximity(places: pd.Series) -> pd.Series:
    """The rank of a page from the places of each of the query's tokens."""
    near = 1 - _WEIGHT * np.sqrt(1 / (_NEAR + _FAR * np.exp(np.arange(REACH + 1) / 1.5 - 2)))

    def of(lists: list) -> float:
        if len(lists) == 1:
            return float(_WEIGHT * np.sum(1 / np.arange(1, len(lists[0]) + 1, dtype=float) ** 2) / _ALL)
        rest = 1.0
        for i, a in enumerate(lists):
            for b in lists[i + 1 :]:
                first, last = np.searchsorted(b, np.asarray(a) - REACH), np.searchsorted(b, np.asarray(a) + REACH, side="right")
                for x, s, e in zip(a, first, last, strict=True):
                    rest *= float(np.prod(near[np.abs(np.asarray(b[s:e]) - x)]))
        return 1 - rest

    return places.map(of)


def _phrase(words: list[str], column: dict[str, str]) -> Column:
    """Whether the words stand one after another somewhere."""
    rest = list(enumerate(words))[1:]
    return F.exists(column[words[0]], lambda s: _all([F.array_contains(F.col(column[w]), s + i) for i, w in rest]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def hits(index: Index, term: str) -> DataFrame:
    """key, rank and first_place (where the excerpt begins) of all pages that match the query."""
    wanted, banned = parse_query(term)
    words = list(dict.fromkeys(w for phrase in wanted for w in phrase))
    postings = index.postings.df
    if not words:
        return postings.select("key", F.lit(0.0).alias("rank"), F.lit(0).alias("first_place")).where("false")
    sizes = dict(index.sizes.df.where(F.col("token").isin(words)).collect())  # a row a word of the query
    ordered = sorted(words, key=lambda w: (sizes.get(w, 0), w))
    column = {w: f"p{i}" for i, w in enumerate(ordered)}
    found = None
    for w in ordered:
        one = postings.where(F.col("token") == w).select("key", F.col("places").alias(column[w]))
        found = one if found is None else found.join(one, "key")
    for phrase in wanted:
        if len(phrase) > 1:
            found = found.where(_phrase(phrase, column))
    if banned:
        found = found.join(postings.where(F.col("token").isin(banned)).select("key"), "key", "left_anti")
    lists = [F.col(column[w]) for w in sorted(words)]
    return found.select("key", F.round(proximity(F.array(*lists)), 6).alias("rank"), _window(lists).alias("first_place"))


def _window(lists: list[Column]) -> Column:
    """The place from which EXCERPT_WORDS tokens hold the most different tokens of the query."""
    held = lambda s: sum((F.exists(p, lambda x: (x >= s) & (x < s + EXCERPT_WORDS)).cast("int") for p in lists), F.lit(0))
    starts = F.array_sort(F.array_distinct(F.concat(*lists)))
    return F.array_max(F.transform(starts, lambda s: F.struct(held(s).alias("n"), (-s).alias("s"))))["s"] * -1


@F.pandas_udf(T.StringType())
def _excerpt(texts: pd.Series, first: pd.Series) -> pd.Series:
    def of(text: str, start: int) -> str:
        lower = text.lower()
        spans = [m.span() for m in re.finditer(r"[^\W_]+", lower)][start : start + EXCERPT_WORDS]
        return re.sub(r"\s+", " ", (text if len(lower) == len(text) else lower)[spans[0][0] : spans[-1][1]]) if spans else ""

    return pd.Series([of(t or "", int(s)) for t, s in zip(texts, first, strict=True)])


def search(index: Index, pages: DataFrame, term: str, limit: int, key: str = "id", text: str = "text") -> DataFrame:
    """The best pages (all columns of ``pages`` but the text, rank and excerpt). ``pages`` holds those that may be shown,
    so that publication is decided before the limit; their texts are read for the shown ones only."""
    shown = pages.drop(text)
    best = shown.join(hits(index, term).withColumnRenamed("key", key), key).orderBy(F.desc("rank"), key).limit(limit)
    rows = Cut(best).df
    keys = [r[0] for r in rows.select(key).collect()]  # no more than the limit
    read = pages.where(F.col(key).isin(keys)).select(key, text)
    return rows.join(F.broadcast(read), key).withColumn("excerpt", _excerpt(text, "first_place")).drop(text, "first_place")


def nearness(distance: int) -> float:
    """What a pair of tokens at a distance adds, for those who check ranks by hand."""
    return _WEIGHT * math.sqrt(1 / (_NEAR + _FAR * math.exp(distance / 1.5 - 2)))
