"""Verdicts, threshold phrases, ring assembly, label points and outlines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import rings, verdicts


def test_verdicts(spark):
    cases = [
        ("paid ₹ 500 per square metre, as agreed", "needs_review", "square metre"),
        ("paid ₹ 500 per day through June", "needs_review", "day"),
        ("paid ₹ 500 per patient per day, it said", "needs_review", "patient per day"),
        ("paid ₹ 500 per", "needs_review", None),
        ("paid ₹ 500 per …", "needs_review", None),
        ("paid ₹ 500 per ₹100 of value", "needs_review", "₹100"),
        ("at the rate of ₹ 500 was", "rejected", None),
        ("area × ₹ 500 = total", "rejected", None),
        ("works of more than ₹ 500 need", "rejected", None),
        ("works of ₹ 500 or more need", "rejected", None),
        ("formula to be applied: ₹ 500 here", "rejected", None),
        ("spent ₹ 500 on roads", "needs_review", None),
    ]
    rows = spark.createDataFrame([(i, t, t.index("₹ 500"), 5) for i, (t, *_) in enumerate(cases)], "i int, t string, at int, n int")
    got = rows.select("i", verdicts.verdict(F.col("t"), F.col("at"), F.col("n")).alias("v"), verdicts.threshold_phrase(F.col("t"), F.col("at"), F.col("n")).alias("p")).orderBy("i").collect()
    for (text, state, unit), r in zip(cases, got, strict=True):
        assert (r.v.state, r.v.per_unit) == (state, unit), text
    assert got[8].p == "more than" and got[9].p == "or more" and got[11].p is None


def test_rings(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert [len(r) for r in rings.close_rings([square[:3], square[:1:-1], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]])] == [5, 4]
    point = lambda p: {"lon": p[0], "lat": p[1]}
    schema = "id int, ways array<array<struct<lon:double,lat:double>>>"
    rows = [(1, [[point(p) for p in square[:3]], [point(p) for p in square[2:]]]), (2, [[point(p) for p in square[:3]]]), (3, None), (4, [[point(square[0]), point(square[1])], [point(square[1]), point(square[0])]])]
    got = {r.id: r.a for r in spark.createDataFrame(rows, schema).select("id", rings.assembled("ways").alias("a")).collect()}
    assert len(got[1].rings[0]) == 5 and got[1].reason is None
    assert got[2].reason == "member ways do not close into a ring" and got[3].reason == "no member ways with geometry" and got[4].reason == "ring has fewer than 3 points"
    ell = [(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10), (0, 0)]
    frame = spark.createDataFrame([(1, [point(tuple(map(float, p))) for p in ell]), (2, None)], "id int, ring array<struct<lon:double,lat:double>>")
    at = frame.where("id = 1").select(rings.label_point("ring").alias("p")).first().p
    assert rings._distance(np.array(ell, float), at.lon, at.lat) > 1.1
    wavy = np.array([(x, 0.001 * (x % 2)) for x in range(50)] + [(49, 30), (0, 30), (0, 0)], float)
    kept = rings.thinned(wavy, 0.01)
    assert kept.sum() == 5 and kept[0] and kept[-1]
    thin = frame.select("id", rings.simplified(0.01)("ring").alias("r")).orderBy("id").collect()
    assert len(thin[0].r) == 7 and thin[1].r is None
