"""Operator 12: language identification by interpolated Kneser-Ney character language models.

A text is read as lower-case letters and marks with one space after each word. Characters below U+1000
are their own codes of 12 bits, later ones are folded into as many, so that ORDER characters are one whole number.

1. Each task counts the ORDER-grams of its texts by language; Spark adds them up. Counts of the shorter ones, by
   Kneser and Ney's rule the number of different characters that stand before them, follow from that table alone.
   All learning documents are counted.
2. Discounts come from how many grams occur once and twice, by language and order. A language's model keeps
   every gram. Grams and contexts are sorted arrays, searched by halving; what is broadcast grows with the distinct
   grams. A caller who sets MODEL_GRAMS bounds that: each language then has its share of so many grams an order, the
   most frequent ones by steps of counts, and what the others held goes to the shorter context.
3. A text's cross-entropy under a model is the mean of minus the logarithms over all its characters. The language with
   the lowest one is chosen (on equal ones the first by name). A task works out each distinct gram once and remembers
   it in a table of fixed size.
4. One learning document in CALIBRATION_SHARE is not counted but calibrates: the sharpness of the softmax that makes
   the score (the most likely of SHARPNESS), and by language the cross-entropy beyond which a text is rejected as none
   of the learned languages (the ACCEPTED quantile of the language's own documents, over all of them, in thousandths).

Defined cases: a null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned;
rows with a null id are scored and never learned from; rows with a null language are never learned from; a language
all of whose documents calibrate is not learned; very long texts are scored whole, some characters at a time;
repeated rows give a row each (and count each in learning); empty tables give empty tables; other columns are kept out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches
from ledgerloom.session import cut

#: Characters of a gram, and bits of one.
ORDER, BITS = 5, 12
#: Grams that all models together keep of an order, to bound what is broadcast; None: all of them.
MODEL_GRAMS: int | None = None
#: One learning document in so many calibrates; the share of its own documents that a language accepts.
CALIBRATION_SHARE, ACCEPTED = 16, 0.999
#: Inverse temperatures that calibration chooses from.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: Characters that are looked up together.
GROUP_CHARS = 2_000_000
#: Values that a task remembers: grams times languages.
_REMEMBERED = 1 << 22
_SPACE = 32

_codes: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    """By code point: the code of a letter or mark, 0 of all else. Built once a worker."""
    if not _codes:
        points = np.arange(0x110000, dtype=np.int64)
        folded = np.where(points < 1 << BITS, points, 64 + ((points * 2654435761 >> 13) % ((1 << BITS) - 64)))
        kept = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
        _codes.append(np.where(kept, folded, 0).astype(np.uint16))
    return _codes[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each kept character of each text, in order, and the n + 1 offsets of the texts in them."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _code_table()[points]
    letter = codes != 0
    # one space after each word; texts end at a line break, so that each begins after none
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    ends = np.cumsum([len(t) + 1 for t in lower])
    offsets = np.concatenate(([0], np.cumsum(kept)[ends - 1])) if texts else np.zeros(1, np.int64)
    stream = np.where(letter[kept], codes[kept], _SPACE).astype(np.int64)
    pad = ORDER - 1
    at = np.arange(len(stream)) + pad * (1 + np.repeat(np.arange(len(texts)), np.diff(offsets)))
    padded = np.full(len(stream) + pad * (len(texts) + 1), _SPACE, np.int64)
    padded[at] = stream
    out = np.zeros(len(stream), np.int64)
    for k in range(pad, -1, -1):
        out = (out << BITS) | padded[at - k]
    return out, offsets


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with GROUP_CHARS characters or one text in each."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if i > a and held + len(t) > GROUP_CHARS:
            yield a, i
            a, held = i, 0
        held += len(t)
    if len(texts) > a:
        yield a, len(texts)


@dataclass
class Models:
    """For each language and order: sorted grams with their discounted shares, sorted contexts with what they pass on."""

    languages: list[str]
    shares: list[list[tuple[np.ndarray, np.ndarray]]]
    passed: list[list[tuple[np.ndarray, np.ndarray]]]
    sharpness: float = 8.0
    limits: list[float] = field(default_factory=list)

    def logs(self, wanted: np.ndarray) -> np.ndarray:
        """Minus the logarithm of the probability of each gram's last character after the others, by language."""
        out = np.empty((len(wanted), len(self.languages)), np.float32)
        for i, (shares, passed) in enumerate(zip(self.shares, self.passed, strict=True)):
            p = np.full(len(wanted), 1 / (1 << BITS))
            for k in range(1, ORDER + 1):
                gram = wanted & ((1 << BITS * k) - 1)
                p = _found(shares[k - 1], gram, 0.0) + _found(passed[k - 1], gram >> BITS, 1.0) * p
            out[:, i] = -np.log(p)
        return out


def _found(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Scorer:
    """Cross-entropies of texts under all models; grams met before come from a table of fixed size."""

    def __init__(self, models: Models):
        self.models = models
        self.bits = max(10, (_REMEMBERED // max(1, len(models.languages))).bit_length() - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, len(models.languages)), np.float32)

    def _values(self, wanted: np.ndarray) -> np.ndarray:
        slot = ((wanted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        unknown, out = self.keys[slot] != wanted, self.values[slot]
        if unknown.any():
            new = np.unique(wanted[unknown])
            logs = self.models.logs(new)
            into = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
            self.keys[into], self.values[into] = new, logs
            out[unknown] = logs[np.searchsorted(new, wanted[unknown])]
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """By text and language; not a number for a text without a letter."""
        n_lang = len(self.models.languages)
        out = np.full((len(texts), n_lang), np.nan)
        step = max(1, GROUP_CHARS * 4 // max(1, n_lang))
        for a, b in _groups(texts):
            wanted, offsets = grams(texts[a:b])
            sums = np.zeros((b - a, n_lang))
            for c in range(0, len(wanted), step):
                part = self._values(wanted[c : c + step])
                begins = np.clip(offsets[:-1] - c, 0, len(part))
                live = np.flatnonzero(np.clip(offsets[1:] - c, 0, len(part)) > begins)
                sums[live] += np.add.reduceat(part, begins[live], axis=0, dtype=np.float64)
            n = np.diff(offsets)
            some = n > 0
            out[a:b][some] = sums[some] / n[some, None]
        return out


def _softmax(entropies: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def count(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for a, b in _groups(texts):
                    keys, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size > 4 * GROUP_CHARS:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _orders(counts: DataFrame) -> list[DataFrame]:
    """lang, gram, n of orders 1 to ORDER; below ORDER, n is the number of different characters before the gram."""
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        tables.append(tables[-1].groupBy("lang", shorter).agg(F.count("*").alias("n")))
    return tables[::-1]


def _kept(order: DataFrame, languages: int) -> DataFrame:
    """lang, gram, share and context of the grams that a model keeps: all, or with MODEL_GRAMS the most frequent of a language, by steps of an eighth power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    most = max(1, MODEL_GRAMS // max(1, languages)) if MODEL_GRAMS else float("inf")
    by_step = order.groupBy("lang", step.alias("step")).agg(F.count("*").alias("grams"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice"))
    least: dict[str, int] = {}
    held: dict[str, int] = {}
    single: dict[str, list[int]] = {}
    full: set[str] = set()
    for row in sorted(by_step.collect(), key=lambda r: -r["step"]):  # some hundred rows a language
        lang = row["lang"]
        seen = single.setdefault(lang, [0, 0])
        seen[0] += row["once"]
        seen[1] += row["twice"]
        held[lang] = held.get(lang, 0) + row["grams"]
        if held[lang] > most:
            full.add(lang)
        if lang not in full or lang not in least:
            least[lang] = row["step"]
    rules = [(lang, least[lang], min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5) for lang, (once, twice) in single.items()]
    spark = order.sparkSession
    rule = F.broadcast(spark.createDataFrame(rules, "lang string, least int, discount double"))  # a row a language
    totals = order.groupBy("lang", F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"))
    kept = order.join(rule, "lang").where(step >= F.col("least")).select("lang", "gram", F.shiftright("gram", BITS).alias("context"), (F.col("n") - F.col("discount")).alias("part"))
    return kept.join(totals, ["lang", "context"]).select("lang", "gram", "context", (F.col("part") / F.col("total")).alias("share"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> Models:
    """Models of all languages of the learning rows (all rows with an id and a language, if none are chosen), calibrated."""
    bounded_batches(docs.sparkSession)
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    calibrates = F.pmod(F.floor(h / 4), F.lit(CALIBRATION_SHARE)) == 5
    counts = cut(count(rows.where(~calibrates), text_col, lang_col))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    shares, passed = [[] for _ in languages], [[] for _ in languages]
    for order in _orders(counts) if languages else []:
        kept = cut(_kept(order, len(languages)))
        rest = kept.groupBy("lang", "context").agg((1 - F.sum("share")).alias("rest"))
        for into, table in ((shares, kept.select("lang", F.col("gram").alias("key"), F.col("share").alias("value"))), (passed, rest.select("lang", F.col("context").alias("key"), F.col("rest").alias("value")))):
            for i, pair in enumerate(_by_language(table.toArrow(), languages)):
                into[i].append(pair)
    models = Models(languages, shares, passed, limits=[float("inf")] * len(languages))
    return _calibrated(models, rows.where(calibrates & F.col(lang_col).isin(languages)), text_col, lang_col) if languages else models


def _by_language(table: pa.Table, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    number = {name: i for i, name in enumerate(languages)}
    lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    keys, values = table["key"].to_numpy(), table["value"].to_numpy().astype(np.float32)
    order = np.lexsort((keys, lang))
    cuts = np.searchsorted(lang[order], np.arange(len(languages) + 1))
    return [(keys[order[a:b]], values[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _calibrated(models: Models, rows: DataFrame, text_col: str, lang_col: str) -> Models:
    """The models with the sharpness and the limits that fit documents that were not counted."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        number = {name: i for i, name in enumerate(shared.value.languages)}
        for batch in batches:
            entropies = scorer.entropies(batch.column(0).to_pylist())
            some = ~np.isnan(entropies[:, 0])
            if not some.any():
                continue
            true = np.array([number[x] for x in batch.column(1).to_pylist()])[some]
            e, at = entropies[some], np.arange(int(some.sum()))
            logs = np.stack([np.log(np.maximum(_softmax(e, t)[at, true], 1e-12)) for t in SHARPNESS], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(true, pa.int32()), pa.array(np.where(e.argmin(axis=1) == true, e[at, true], np.nan), pa.float64(), from_pandas=True), pa.array(logs.tolist(), pa.list_(pa.float64()))], ["lang", "own", "logs"])

    scored = rows.select(text_col, lang_col).mapInArrow(run, "lang int, own double, logs array<double>")
    met = scored.groupBy("lang").agg(F.percentile(F.ceil(F.col("own") * 1000) / 1000, ACCEPTED).alias("limit"), *(F.sum(F.get("logs", F.lit(i))).alias(f"s{i}") for i in range(len(SHARPNESS)))).collect()
    shared.unpersist()
    if met:
        sums = [sum(r[f"s{i}"] for r in sorted(met, key=lambda r: r["lang"])) for i in range(len(SHARPNESS))]
        models.sharpness = SHARPNESS[int(np.argmax(sums))]
        for r in met:
            if r["limit"] is not None:
                models.limits[r["lang"]] = r["limit"]
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred (the likeliest learned language, or `und`), score, cross_entropy, accepted."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, limits = Scorer(m), np.array(m.limits)
        for batch in batches:
            n = batch.num_rows
            names, score, best, accepted = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if m.languages:
                entropies = scorer.entropies([t or "" for t in batch.column(1).to_pylist()])
                some = np.flatnonzero(~np.isnan(entropies[:, 0]))
                if len(some):
                    at = entropies[some].argmin(axis=1)
                    best[some] = entropies[some, at]
                    score[some] = _softmax(entropies[some], m.sharpness)[np.arange(len(some)), at]
                    accepted[some] = best[some] <= limits[at]
                    for i, k in zip(some.tolist(), at.tolist(), strict=True):
                        names[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64(), from_pandas=True), pa.array(accepted)], [id_col, "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, accepted boolean")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: learned from rows whose crc32 of the id, modulo 4, is not 2."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = fit(docs, learn=~held_out)
    return identify(docs, models).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
