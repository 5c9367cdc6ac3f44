"""Runs, language models and phrases against brute force, with the cases that each docstring defines."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, WORD, corpus

from ledgerloom.llm import collocations, langid, runs

ODD = [(None, "a b " * 60, None, None, None), (7, "x y z " * 50, "en", "s", 1), (7, "x y z " * 50, "en", "s", 1), (8, None, None, "s", 1), (9, " \n\t", "fr", None, 1)]
CLASHES = ("words", "runs", "n", "f", "phrase", "part", "own", "gram", "key", "value", "score", "salt", "rank", "k", "block")


def widened(df):
    """The same rows with further columns whose names the operators use inside."""
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- runs


def brute_runs(words: list, least: int = 24) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if (n := j - i + q) >= max(least, 3 * q):
                found.setdefault((i, n), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id: int | None, text: str | None) -> tuple:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(kept))


def test_runs_of_random_words_by_brute_force():
    draw = random.Random(5)
    for _ in range(1500):
        k, words = draw.choice([1, 2, 2, 3, 5, 30]), []
        for _ in range(draw.randint(1, 6)):
            unit = [str(draw.randrange(k)) for _ in range(draw.randint(1, 20))]
            words += (unit * draw.randint(1, 12))[: draw.randint(1, 150)] if draw.random() < 0.6 else unit
        ((found, split),) = runs.search([" ".join(words).encode()], [None])
        assert found == brute_runs(words) and len(split) == len(words)


def test_runs_of_a_group_of_texts_do_not_mix():
    texts = [b"a b c " * 30, b"a b c " * 30, b"", b"c " * 23, b"c " * 24]
    assert [r for r, _ in runs.search(texts, [None] * 5)] == [[(0, 90, 3)], [(0, 90, 3)], [], [], [(0, 24, 1)]]


def test_runs_of_long_texts_take_time_in_proportion():
    ((found, _),) = runs.search([b"a " * 120_000], [None])
    assert found == [(0, 120_000, 1)]
    unit = b" ".join(b"%d" % (i * i % 7919) for i in range(7919))
    ((found, _),) = runs.search([b" ".join([unit] * 12)], [None])
    assert (0, 7919 * 12, 7919) in found


@pytest.mark.parametrize("kind", ["corpus", "odd", "empty"])
def test_runs_query_by_brute_force(spark, kind):
    draw = random.Random(2)
    made = corpus(n=40) + [(1000 + i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 200))), "en", "s", 0) for i in range(80)]
    data = {"corpus": made, "odd": ODD, "empty": []}[kind]
    got = runs.report(widened(spark.createDataFrame(data, SCHEMA)))
    assert got.columns[0] == "doc_id" and rows_of(got) == sorted((brute_row(r[0], r[1]) for r in data), key=repr)


def test_collapsed_text_keeps_one_period(spark):
    got = runs.collapse(spark.createDataFrame([(1, "x " + "a b c " * 20 + "y")], "doc_id bigint, text string")).first()
    assert got["collapsed"] == "x a b c y" and [tuple(r) for r in got["runs"]] == [(1, 60, 3)] and got["n_words"] == 62


# ---- language models


def normal(text: str) -> str:
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return "".join(w + " " for w in kept.split(" ") if w)


def brute_entropy(learned: list[str], text: str) -> float:
    """Interpolated Kneser-Ney by dictionaries of strings."""
    order = langid.ORDER
    counts = [Counter() for _ in range(order + 1)]
    for t in learned:
        padded = " " * (order - 1) + normal(t)
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, kinds = [0.0] * (order + 1), [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        once, twice = (sum(n == m for n in counts[k].values()) for m in (1, 2))
        discount[k] = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g: str) -> float:
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 4096
        seen = total[k][g[:-1]]
        return (max(counts[k][g] - discount[k], 0) + discount[k] * kinds[k][g[:-1]] * below) / seen if seen else below

    padded = " " * (order - 1) + normal(text)
    return -sum(math.log(p(padded[i : i + order])) for i in range(len(padded) - order + 1)) / (len(padded) - order + 1)


def prose(draw: random.Random, parts: str, n: int) -> str:
    parts = parts.split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(n)).capitalize() + "."


SOUNDS = {"en": "the ing wh sh tion and ed", "fr": "eau ou é que ai ça è", "ja": "こ ん に ち は 世 界", "hi": "की है का मैं हिं"}


def languages(n: int, seed: int = 1) -> list[tuple]:
    draw = random.Random(seed)
    return [(i, prose(draw, SOUNDS[lang], draw.randint(1, 60)), lang, "s", 0) for i in range(n) for lang in [list(SOUNDS)[i % 4]]]


def test_cross_entropies_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "_REMEMBERED", 1 << 8)  # a table so small that grams push each other out
    data = languages(160)
    models = langid.fit(spark.createDataFrame(data, SCHEMA))
    counted = [r for r in data if zlib.crc32(str(r[0]).encode()) // 4 % 16 != 5]
    texts = ["Wh andtion", "é", "The 世界 123 ...", "zz-zz", "aiai. " * 50, "Straße und İstanbul"]
    scorer = langid.Scorer(models)
    scorer.bits, scorer.keys, scorer.values = 3, scorer.keys[:8], scorer.values[:8]
    for _ in range(2):
        got = scorer.entropies(texts)
        for i, lang in enumerate(models.languages):
            want = [brute_entropy([r[1] for r in counted if r[2] == lang], t) for t in texts]
            assert np.allclose(got[:, i], want, rtol=1e-4), lang


def test_probabilities_add_up_to_one_with_dropped_grams(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_GRAMS", 40)
    models = langid.fit(spark.createDataFrame(languages(120), SCHEMA))
    assert all(len(keys) <= 2 * 40 for shares in models.shares for keys, _ in shares)
    context = langid.grams(["the"])[0][2]
    every = ((int(context) << 12) & ((1 << 60) - 1)) | np.arange(4096)
    assert np.allclose(np.exp(-models.logs(every).astype(float)).sum(axis=0), 1, atol=1e-3)


def test_languages_of_rows_that_were_not_learned(spark):
    data = [*languages(400), (900, None, "en", None, 0), (901, "12 34 !?", "en", None, 0), (None, "the and wh", None, None, 0), (902, "の" * 3000, "ja", None, 0)]
    got = langid.report(widened(spark.createDataFrame(data, SCHEMA))).collect()
    by_id = {r["doc_id"]: r for r in got}
    truth = {r[0]: r[2] for r in data[:400]}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(data) and all(by_id[i]["held_out"] == (i in held) for i in truth)
    assert sum(by_id[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (900, 901)] == [("und", 0.0)] * 2
    assert by_id[None]["lang_pred"] == "en" and by_id[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got)
    foreign = langid.identify(spark.createDataFrame([(1, "ъыь " * 40)], "doc_id bigint, text string"), langid.fit(spark.createDataFrame(languages(400), SCHEMA))).first()
    assert foreign["accepted"] is False


def test_nothing_to_learn_from(spark):
    empty = langid.report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    only_null = langid.report(spark.createDataFrame([(1, "some words", None, None, 0), (2, None, "en", None, 0)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in only_null} == {("und", 0.0)}


def test_texts_in_pieces_score_alike(spark, monkeypatch):
    models = langid.fit(spark.createDataFrame(languages(120), SCHEMA))
    texts = [r[1] for r in languages(50, 3)] + ["", "..."]
    whole = langid.Scorer(models).entropies(texts)
    monkeypatch.setattr(langid, "GROUP_CHARS", 7)
    assert np.allclose(langid.Scorer(models).entropies(texts), whole, equal_nan=True)


# ---- phrases


def brute_phrases(data: list[tuple], least: int, top: int = 2000) -> list[tuple]:
    counts: dict[str, Counter] = defaultdict(Counter)
    n: Counter = Counter()
    for r in data:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang := r[2] or "und"] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        covered = {q for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * a >= 100 * f[q]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, j = min((1000 * a * n[lang] // (f[p[:j]] * f[p[j:]]), j) for j in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:j]], f[p[j:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def phrase_rows(seed: int = 4) -> list[tuple]:
    draw = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "x\x01", "a", "b"]
    rows = []
    for i in range(150):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n"]) for _ in range(draw.randint(0, 60)))
        rows.append((i, text + draw.choice(["", "New York city ", "a b a b a b "]), draw.choice(["en", "en", "fr", None, "und"]), "s", 0))
    return [*rows, (None, None, "en", None, 0), (3, "", None, None, 0), (5, "a b " * 300, "en", "s", 0)]


@pytest.mark.parametrize("ranged", [False, True])
def test_phrases_by_brute_force(spark, monkeypatch, ranged):
    if ranged:  # borders inside the phrases of one word, counters that nearly all clash
        monkeypatch.setattr(collocations, "RANGE_ROWS", 7)
    data = phrase_rows()
    got = collocations.mine(widened(spark.createDataFrame(data, SCHEMA)), min_count=8)
    assert rows_of(got) == brute_phrases(data, 8)
    assert rows_of(collocations.mine(spark.createDataFrame(data, SCHEMA), min_count=8, top=5)) == brute_phrases(data, 8, 5)


def test_phrases_with_few_counters_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(collocations, "COUNTERS", (1 << 16, 1 << 16))
    monkeypatch.setattr(collocations, "GROUP_BYTES", 300)
    data = phrase_rows(9)
    assert rows_of(collocations.mine(spark.createDataFrame(data, SCHEMA), min_count=300)) == brute_phrases(data, 300)


def test_phrases_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "a b c", "en", "s", 0)], SCHEMA)).count() == 0
