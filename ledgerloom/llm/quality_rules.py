"""Operator 1: quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared with those of its
language by the Jensen-Shannon distance. The references come from all documents of the language that
pass the base rules: class counts, and the words that make up at least COMMON_SHARE of its words.
A histogram of a text below its length guard is not judged.

Three passes, none of which moves text between tasks:

1. Every group of passing documents in a task counts its words and names those with half of COMMON_SHARE of a
   language's words in the group, with their gain: their count above that half. A word with COMMON_SHARE
   overall has, over the groups that name it, a gain of half of COMMON_SHARE of all words or more, since the
   other groups hold less than the half. Words of less gain go; at most 2 / COMMON_SHARE a language stay.
2. The named words are counted exactly, and only these small counts are shuffled.
3. Each document is judged against its language's reference, which a join by language brings in.

Defined cases: a null text is the empty text (it fails the base rules); a null or unknown language is
judged as the language ''; a language without reference documents leaves the base rules' verdict;
repeated rows give a row each; null ids stay null; very long texts are counted whole; a word exactly at COMMON_SHARE
is common, so there are no ties; empty tables give empty tables; other columns are kept by ``keep``, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast
from pyspark.sql.types import StructField, StructType

from ledgerloom.llm.text import bounded_batches
from ledgerloom.session import Cut

#: A word is common in a language if it is at least this share of the language's words.
COMMON_SHARE = 0.004
#: Jensen-Shannon distances (base 2, so 0 to 1) beyond which a document is rejected: a limit for long texts
#: and what is added for the noise of short ones, divided by the root of their characters or words.
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.2, 1.0
MAX_WORD_DISTANCE, WORD_NOISE = 0.24, 0.6
#: Length guards: characters for the class histogram, words for the word histogram.
MIN_CHARS, MIN_WORDS = 100, 50
#: Words of a language that a group of documents holds at least before it names its common words.
GROUP_WORDS = 200_000
#: Most common words of all languages together that go to the tasks, some 50 MB; 2 / COMMON_SHARE a language at most.
MAX_NAMED = 1_000_000
#: Most languages whose references are sent to all tasks; beyond it the join shuffles.
BROADCAST_LANGUAGES = 2000

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_PUNCTUATION = ".,;:'\"()-?"
CLASSES = ("lower", "upper", "letter", "digit", "space", "punctuation", "emphasis", "symbol")


def _class_table() -> np.ndarray:
    """The class of every code point of the first plane; others count as letters."""
    table = np.empty(65536, np.uint8)
    of = {c: i for i, c in enumerate(CLASSES)}
    by_category = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "N": "digit", "Z": "space", "Cc": "space", "L": "letter", "M": "letter"}
    for code in range(65536):
        category = unicodedata.category(chr(code))
        table[code] = of[by_category.get(category) or by_category.get(category[0]) or "symbol"]
    for c in _PUNCTUATION:
        table[ord(c)] = of["punctuation"]
    table[ord("!")] = of["emphasis"]
    return table


_tables: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    if not _tables:
        _tables.append(_class_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(codes < 65536, _tables[0][np.minimum(codes, 65535)], CLASSES.index("letter")), minlength=len(CLASSES))


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of so many words that occurs twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    span = 1
    while span < width:  # hashes of windows: if all differ, no window occurs twice
        hashes = hashes[:-span] * np.uint64(0x9E3779B97F4A7C15) + (hashes[span:] ^ (hashes[span:] >> np.uint64(29)))
        span *= 2
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    span = 1
    while span < width:  # ids of windows of twice the width, from pairs of ids
        pairs = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        _, ids = np.unique(pairs, return_inverse=True)
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def reference_words(text: str) -> list[bytes]:
    """The words of a text that passes the base rules, so that its language's reference counts it; none of another."""
    words = text.encode("utf-8", "surrogatepass").split()
    return words if len(words) >= 20 and not base_failed(len(words), repeated_window_words(words)) else []


def base_features(text: str) -> dict:
    """The base columns of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    dup_lines = 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in seen:
                dup_lines += bool(line.split())
            else:
                seen.add(line)
    repeats = repeated_window_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _SPACES)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "base_failed": base_failed(len(words), repeats),
    }


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms, base 2: the root of the mean divergence from their middle."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        yield from zip((x or "" for x in batch.column(0).to_pylist()), (x or "" for x in batch.column(1).to_pylist()), strict=True)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: the named words of each group of this task's documents with their gains; '' has the number of words."""
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()

    def out(lang: str) -> pa.RecordBatch:
        total = totals.pop(lang)
        half = COMMON_SHARE / 2 * total
        gains = {w.decode("utf-8", "replace"): n - half for w, n in counts.pop(lang).items() if n >= half} | {"": float(total)}
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(gains), pa.string()), pa.array(gains.keys(), pa.string()), pa.array(gains.values(), pa.float64())], ["lang", "word", "gain"])

    for lang, text in _rows(batches):
        words = reference_words(text)
        if not words:
            continue
        counts.setdefault(lang, Counter()).update(words)
        totals[lang] += len(words)
        if totals[lang] >= GROUP_WORDS:
            yield out(lang)
    for lang in list(totals):
        yield out(lang)


def _counted(words_of: dict[str, set[bytes]]):
    """Pass 2: exact counts of the named words, and the class counts, of the documents that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for lang, text in _rows(batches):
            got = reference_words(text)
            if not got:
                continue
            mine = words.setdefault(lang, Counter())
            named = words_of.get(lang, ())
            mine.update(w.decode("utf-8", "replace") for w in got if w in named)
            mine[""] += len(got)
            classes[lang] = classes.get(lang, 0) + class_counts(text)
        rows = [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "c", name, int(n)) for lang, c in classes.items() for name, n in zip(CLASSES, c, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "kind", "name", "n"])

    return run


def references(docs: DataFrame) -> DataFrame:
    """One row a language: its class counts, its common words with their counts, and its number of words."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("lang", "text")
    gains = Cut(texts.mapInArrow(_named, "lang string, word string, gain double").groupBy("lang", "word").agg(F.sum("gain").alias("gain"))).df
    totals = gains.where("word = ''").select("lang", F.col("gain").alias("total"))
    # collected: at most 2 / COMMON_SHARE words a language, by the argument above (a thousandth is left for rounding)
    named = gains.where("word != ''").join(totals, "lang").where(F.col("gain") >= 0.999 * COMMON_SHARE / 2 * F.col("total"))
    words_of: dict[str, set[bytes]] = {}
    found = named.select("lang", "word").limit(MAX_NAMED + 1).collect()
    if len(found) > MAX_NAMED:
        raise ValueError(f"more than {MAX_NAMED} common words in all languages together: map rare language codes to one first")
    for lang, word in found:
        words_of.setdefault(lang, set()).add(word.encode("utf-8", "surrogatepass"))
    counted = texts.mapInArrow(_counted(words_of), "lang string, kind string, name string, n bigint")
    summed = counted.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    total = F.max(F.when((F.col("kind") == "w") & (F.col("name") == ""), F.col("n")))
    entries = lambda kind: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("name") != ""), F.struct("name", "n"))))
    grouped = summed.groupBy("lang").agg(entries("c").alias("classes"), entries("w").alias("words"), total.alias("n_words"))
    return grouped.withColumn("words", F.expr(f"filter(words, w -> w.n >= {COMMON_SHARE} * n_words)"))


def _judge(text: str, classes: dict[str, int] | None, words: dict[str, int] | None, n_ref: int | None) -> dict:
    row = base_features(text)
    row |= {"class_distance": None, "word_distance": None}
    if classes:
        own = class_counts(text)
        if own.sum() >= MIN_CHARS:
            row["class_distance"] = jensen_shannon(own, np.array([classes.get(c, 0) for c in CLASSES], float))
    if words and row["n_words"] >= MIN_WORDS:
        hits = Counter(w for w in (x.decode("utf-8", "replace") for x in text.encode("utf-8", "surrogatepass").split()) if w in words)
        own = np.array([*(hits[w] for w in words), row["n_words"] - sum(hits.values())], float)
        row["word_distance"] = jensen_shannon(own, np.array([*words.values(), n_ref - sum(words.values())], float))
    far = (row["class_distance"] or 0) > MAX_CLASS_DISTANCE + CLASS_NOISE / max(1, len(text)) ** 0.5
    far |= (row["word_distance"] or 0) > MAX_WORD_DISTANCE + WORD_NOISE / max(1, row["n_words"]) ** 0.5
    row["kept"] = not (row["base_failed"] or far)
    return row


_VERDICT = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
)
_VERDICT_SQL = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, kept: boolean, class_distance: double, word_distance: double>"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3. Columns: the carried struct, text, and the language's reference."""
    refs: dict[str, tuple] = {}
    for batch in batches:
        langs = batch.column(2).to_pylist()
        for i, lang in enumerate(langs):
            if lang is not None and lang not in refs:
                classes, words, total = (batch.column(k)[i].as_py() for k in (3, 4, 5))
                refs[lang] = ({e["name"]: e["n"] for e in classes or []}, {e["name"]: e["n"] for e in words or []}, total)
        rows = [_judge(t or "", *refs.get(lang, (None, None, None))) for t, lang in zip(batch.column(1).to_pylist(), langs, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _VERDICT)], ["doc", "verdict"])


def _judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(doc, verdict): the carried columns as one struct, so that their names clash with nothing, and the verdict."""
    refs = Cut(references(docs).select(F.col("lang").alias("_lang"), "classes", "words", "n_words")).df
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_doc"), F.col("text").alias("_text"), F.coalesce(F.col("lang"), F.lit("")).alias("_of"))
    joined = left.join(broadcast(refs) if few else refs, F.col("_of") == F.col("_lang"), "left")
    schema = StructType([StructField("doc", StructType([docs.schema[c] for c in carried])), *StructType.fromDDL(f"verdict {_VERDICT_SQL}").fields])
    return joined.select("_doc", "_text", "_lang", "classes", "words", "n_words").mapInArrow(_verdicts, schema)


def judge(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns of every document with the base columns, both distances and the verdict."""
    return _judged(docs, list(carried)).select("doc.*", "verdict.*")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns that they came with."""
    return _judged(docs, docs.columns).where("verdict.kept").select("doc.*")
