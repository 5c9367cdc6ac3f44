"""Bounds of what tasks hold, and results that must not depend on them."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import ann, langid, line_dedup


def _searched(batches, ids, queries, centre, k):
    """The rows of one task of a block's search, without a session."""
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    index = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, _: list(run(iter(batches))))
    return ann._search_block(index, ids, queries, centre, k)


def test_a_search_holds_no_more_than_a_step_of_pairs():
    v = np.random.default_rng(4).normal(size=(6000, 64))
    centre, ids = v.mean(axis=0), np.arange(6000)
    bits, length, own = ann.encode(v, centre, ann.rotation(64))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(v)), pa.array([b.tobytes() for b in bits]), pa.array(length), pa.array(own)], ["id", "v", "bits", "length", "own"])
    asked = ids[::3]
    tracemalloc.start()
    parts = _searched([batch], asked, v[asked], centre, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # all pairs that the bounds let through, held together, took several times as much
    found = {}
    for part in parts:
        for q, i, s in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found.setdefault(q, []).append((s, i))
    for q in asked[::50].tolist():
        gap = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        assert [i for _, i in sorted(found[q])] == np.argsort(gap, kind="stable")[:10].tolist()


def _random_lines(draw, n, words):
    """Lines of words of three letters, and of each line a copy with some words exchanged."""
    pool = ["".join(x) for x in draw.choice(list("abcdefghijklmnopqrstuvwxyz"), size=(4000, 3))]
    for i in range(n):
        line = draw.choice(pool, words[i % len(words)])
        yield " ".join(line)
        line[draw.choice(len(line), int(len(line) * (0.03, 0.08, 0.3)[i % 3]), replace=False)] = draw.choice(pool)
        yield " ".join(line)


def test_pairs_that_may_be_alike_are_all_links_and_few_others(spark):
    texts = sorted(set(_random_lines(np.random.default_rng(5), 90, (14, 31, 33, 64, 70, 150, 400))))
    lines = line_dedup._lines(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    sketched = line_dedup._sketched(line_dedup._signatures(lines)).localCheckpoint()
    side = lambda s: line_dedup._side(sketched, s).join(sketched.select(F.col("h").alias(f"h_{s}"), F.col("id").alias(f"id_{s}")), f"h_{s}")
    hopeful = {tuple(r) for r in side("x").join(side("y"), F.expr(f"id_x < id_y AND {line_dedup._hopeful('x', 'y', 80)}")).select("id_x", "id_y").collect()}
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    links, unlike = {p for p, j in like.items() if j >= 0.8}, {p for p, j in like.items() if j < 0.4}
    assert len(links) > 25 and links <= hopeful
    assert len(unlike & hopeful) < len(unlike) / 200  # the sketches alone let some percent of them through


def test_fuzzy_lines_do_not_depend_on_the_turns(spark, monkeypatch):
    draw = np.random.default_rng(6)
    base = " ".join("".join(x) for x in draw.choice(list("abcdefghij"), size=(60, 4))).split()
    rows = []
    for i in range(60):
        words = list(base)
        for k in draw.choice(60, i % 9, replace=False):
            words[k] = f"x{i}{k}"
        rows.append((i, "head\n" + " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, line_dedup.report(frame).collect()))
    monkeypatch.setattr(line_dedup, "MET_A_LINE", 30)
    monkeypatch.setattr(line_dedup, "PAIRS_A_LINE", 8)
    assert sorted(map(tuple, line_dedup.report(frame).collect())) == want
    assert sum(r[2] for r in want) > 60


def test_a_language_model_keeps_every_gram(spark):
    order = spark.createDataFrame([("en", g, 1 + g % 5) for g in range(200)], "lang string, gram long, n long")
    assert langid._kept(order, 10**6).select("gram").distinct().count() == 200
