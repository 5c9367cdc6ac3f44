"""Correction requests, batches and readings: odd input, illegal orders, any order of batches."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from ledgerloom.operators import corrections, readings


def test_problems(spark):
    rows = [
        ("fact:12", "other", "long enough text", None, None, []), (" page:/a/b ", "missing", "long enough text", " https://x.org/1 ", " ", []),
        (None, None, None, None, None, ["subject", "category", "description_short"]), ("fact:012", "Other", " short    \n ", "http://a b", "x", ["automated", "subject", "category", "description_short", "evidence_url"]),
        ("page:/" + "a" * 300, "other", "x" * 4000, "http://" + "a" * 993, "", []), ("page:/" + "a" * 301, "other", "x" * 4001, "http://" + "a" * 994, "", ["subject", "description_long", "evidence_url"]),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, s string, c string, d string, u string, h string")
    got = dict(df.select("i", corrections.problems(*[F.col(c) for c in "scduh"])).collect())
    assert [got[i] for i in range(len(rows))] == [r[5] for r in rows]


def test_decisions_over_a_log(spark):
    requests = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "reference string, received_at int")
    log = [
        (1, "A", "corrected", "ann", " ", 10), (2, "A", "corrected", "ann", "reread", 11), (3, "A", "reviewing", "bob", None, 12), (4, "A", "reviewing", "bob", None, 13), (5, "A", "no_change", None, "x", 14),
        (6, "A", "no_change", "cyd", "same", 15), (7, "Z", "reviewing", "ann", None, 16), (8, "B", "received", "ann", None, 17), (9, "B", None, "ann", None, 18), (10, "C", "reviewing", "ann", "look", 19),
    ]
    decisions = spark.createDataFrame(log, "seq int, reference string, status string, reviewer string, note string, at int")
    got = {r["seq"]: r["outcome"] for r in corrections.outcomes(requests, decisions).collect()}
    assert got == {1: "no_note", 2: "decided", 3: "decided", 4: "decided", 5: "no_reviewer", 6: "decided", 7: "unknown_reference", 8: "unknown_status", 9: "unknown_status", 10: "decided"}
    now = {r["reference"]: tuple(r)[2:] for r in corrections.current(requests, decisions).collect()}
    assert now == {"A": ("no_change", "cyd", 15, "same"), "B": ("received", None, None, None), "C": ("reviewing", None, None, "look")}
    past = sorted(tuple(r) for r in corrections.history(requests, decisions).where("reference = 'A'").collect())
    assert past == [("A", 2, "received", None, None, None, 11), ("A", 3, "corrected", "ann", 11, "reread", 12), ("A", 6, "reviewing", "ann", 11, "reread", 15)]
    assert [r["reference"] for r in corrections.open_requests(corrections.current(requests, decisions)).collect()] == ["B", "C"]
    assert corrections.current(requests, decisions.where("false")).where("status = 'received'").count() == 3


def test_batches_are_taken_whole(spark):
    rows = [("a", 1, "1.5", "crore", "n"), ("a", 2, "12.34", "rupees", "n"), ("b", 3, "1", "lakh", "n"), ("b", 4, "1.005", "rupees", "n"), ("c", None, "1", "lakh", "n"), (None, 5, "1", "lakh", "n"), ("d", 6, "", "lakh", "n"), ("e", 7, "1", None, "n"), ("f", 8, "1", "lakh", " "), ("g", 9, "1", "dozen", "n")]
    got = {(r["batch"], r["id"]): (r["paise"], r["problem"], r["taken"]) for r in corrections.prepared(spark.createDataFrame(rows, "batch string, id int, amount string, unit string, note string")).collect()}
    assert got["a", 1] == (1500000000, None, True) and got["a", 2] == (1234, None, True) and got[None, 5] == (10000000, None, True)
    assert got["b", 3][1:] == (None, False) and got["b", 4] == (None, "not exact", False)
    assert [got[k][1] for k in (("c", None), ("d", 6), ("e", 7), ("f", 8), ("g", 9))] == ["id", "amount", "unit", "note", "not exact"]


LOG = "document_id int, page_number int, engine string, engine_version string, languages string, dpi int, seq int, refusal string, content string"


def test_readings_in_any_order(spark):
    draw = random.Random(4)
    rows = [(1, draw.randint(1, 2), draw.choice("xy"), draw.choice("12"), "en", 300, i, draw.choice([None, None, f"r{i}"]), f"t{i}") for i in range(40)]
    batches = [rows[:15], rows[15:22], rows[10:30], rows[30:]]
    frame = lambda b: spark.createDataFrame(b, LOG)
    want = None
    for order in list(itertools.permutations(range(4)))[::5]:
        store = readings.folded(frame([]))
        for i in order:
            store = spark.createDataFrame(readings.folded(store, frame(batches[i])).collect(), LOG)
        got = sorted(map(tuple, readings.standing(store).collect()), key=repr)
        assert want is None or got == want
        want = got
    made: dict = {}
    refused: dict = {}
    for r in rows:  # one after another, as a table would be written
        page = r[1:3]
        if r[7] is None:
            if r[1:4] not in made:
                made[r[1:4]] = r[6]
                refused.pop(page, None)
        else:
            refused[page] = r[6]
    assert sorted(x[6] for x in want) == sorted([*made.values(), *refused.values()])


def test_prior_decisions_and_benchmark(spark):
    past = spark.createDataFrame([(1, 7, 10), (2, 7, 12), (3, 8, 11), (4, 7, 12)], "id int, fact_id int, superseded_at int")
    assert [r["id"] for r in corrections.prior_decisions(past, 7).collect()] == [4, 2, 1]
    scores = spark.createDataFrame([("x", "table", 10, 8, 4), ("x", "table", 0, 0, 0), ("y", "text", 0, 5, 0)], "engine string, class string, truth int, found int, shared int")
    assert {(r["engine"], r["pages"], r["recall"], r["precision"]) for r in readings.benchmark(scores).collect()} == {("x", 2, 0.4, 0.5), ("y", 1, None, 0.0)}
