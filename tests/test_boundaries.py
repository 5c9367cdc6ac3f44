"""Boundaries: bow-ties, holes, islands in lakes, split ways, refusals, claims."""

from __future__ import annotations

import random

from ledgerloom.operators import boundaries

ELEMENTS = "type string, id bigint, tags map<string,string>, members array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>"


def square(x: float, y: float, size: float, clockwise: bool = False) -> list[tuple]:
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return ring[::-1] if clockwise else ring


def units(spark, **shapes):
    rows = [(i, n, "district", None, [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings], None) for i, (n, rings) in enumerate(shapes.items())]
    return spark.createDataFrame(rows, "osm_relation_id int, name string, level string, lgd_code string, rings array<array<struct<lon:double,lat:double>>>, reason string")


def test_shapes(spark):
    touching = [(70, 10), (71, 10), (71, 11), (70.5, 10), (70, 11), (70, 10)]
    back = [(70, 10), (72, 10), (71, 10), (71, 11), (70, 10)]
    got = {
        r["name"]: (r["reason"], r["polygons"] and [len(p) for p in r["polygons"]], r["area"] and round(r["area"], 9))
        for r in boundaries.valid(
            units(
                spark, plain=[square(70, 10, 1, True)], bow=[[(70, 10), (71, 11), (71, 10), (70, 11), (70, 10)]], hole=[square(70.25, 10.25, 0.5), square(70, 10, 1)],
                island=[square(70, 10, 3), square(70.5, 10.5, 2), square(71, 11, 1, True), square(71.25, 11.25, 0.25)], two=[square(70, 10, 1), square(80, 20, 2)],
                lapping=[square(70, 10, 1), square(70.5, 10.5, 1)], touching=[touching], back=[back], flat=[[(70, 10), (71, 10), (70.5, 10), (70, 10)]], long=[[(68, 6), (98, 6.1), (98, 37), (68, 36), (68, 6)]],
            )
        ).collect()
    }
    bad = ("rings cross or touch themselves", None, None)
    assert {k: v for k, v in got.items() if k != "long"} == {
        "plain": (None, [1], 1.0), "bow": bad, "hole": (None, [2], 0.75), "island": (None, [2, 2], 9 - 4 + 1 - 0.0625), "two": (None, [1, 1], 5.0), "lapping": bad, "touching": bad, "back": bad, "flat": bad,
    }
    assert got["long"][0] is None


def test_turning(spark):
    rows = boundaries.nested(boundaries.ring_rows(units(spark, x=[square(70, 10, 3, True), square(71, 11, 1)]))).collect()
    assert {r["ring"]: (r["role"], r["parent"], [tuple(p) for p in r["points"]]) for r in rows} == {0: ("outer", None, square(70, 10, 3)), 1: ("hole", 0, square(71, 11, 1, True))}


def test_crossings_by_brute_force(spark):
    draw = random.Random(5)
    shapes = {f"s{i}": [[(70 + draw.randint(0, 12) / 4, 10 + draw.randint(0, 12) / 4) for _ in range(draw.randint(3, 7))]] for i in range(60)}
    for rings in shapes.values():
        rings[0].append(rings[0][0])

    def turn(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def bad(ring):
        sides = [(i, a, b) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False)) if a != b]
        for n, (i, a, b) in enumerate(sides):
            for j, c, d in sides[n + 1 :]:
                if j == i + 1 or (i == 0 and j == len(ring) - 2):
                    if turn(c, d, a) == turn(c, d, b) == 0 and (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) < 0:
                        return True
                elif max(a[0], b[0]) >= min(c[0], d[0]) and max(c[0], d[0]) >= min(a[0], b[0]) and max(a[1], b[1]) >= min(c[1], d[1]) and max(c[1], d[1]) >= min(a[1], b[1]) and turn(c, d, a) * turn(c, d, b) <= 0 and turn(a, b, c) * turn(a, b, d) <= 0:
                    return True
        return False

    rows = units(spark, **shapes)
    got = {r[0] for r in boundaries.crossing(boundaries.ring_rows(rows)).select("osm_relation_id").collect()}
    assert got == {i for i, rings in enumerate(shapes.values()) if bad(rings[0])}


def test_relations_and_refusals(spark):
    line = lambda *ps: ("way", "outer", [(y, x) for x, y in ps])
    closed = [line((70.0, 10.0), (71.0, 10.0), (71.0, 11.0)), line((70.0, 10.0), (70.0, 11.0), (71.0, 11.0))]
    rows = [
        ("relation", 1, {"name": " A ", "admin_level": "5", "ref:LGD:district": "12"}, closed), ("relation", 2, {"name": "B", "admin_level": "5", "ref:LGD:subdistrict": "12"}, closed), ("node", 3, {"name": "C"}, None),
        ("relation", 4, None, closed), ("relation", 5, {"name": "E"}, closed), ("relation", 6, {"name": "F", "admin_level": "5.5"}, closed), ("relation", 7, {"name": "G", "admin_level": "3"}, closed),
        ("relation", 8, {"name": "H", "admin_level": "6"}, closed[:1]), ("relation", 9, {"name": "I", "admin_level": "6"}, None), ("relation", 10, {"name": "J", "admin_level": "6", "ref:LGD": "4"}, [line((7.0, 10.0), (71.0, 10.0), (71.0, 11.0), (7.0, 10.0))]),
    ]
    got = {r["osm_relation_id"]: (r["level"], r["lgd_code"], r["reason"]) for r in boundaries.parsed(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got == {
        1: ("district", "12", None), 2: ("district", None, None), 4: (None, None, "no name tag"), 5: (None, None, "admin_level is not an integer: absent"), 6: (None, None, "admin_level is not an integer: 5.5"),
        7: (None, None, "admin_level 3 has no ledger level"), 8: (None, None, "member ways do not close into a ring"), 9: (None, None, "no member ways with geometry"), 10: (None, None, "coordinate outside India: 7.0,10.0"),
    }
    assert boundaries.valid(boundaries.parsed(spark.createDataFrame([], ELEMENTS))).count() == 0


def test_claims_and_upserts(spark):
    held = spark.createDataFrame([(1, "district", "12", "Old", 9, None), (2, "district", "13", "Held", 9, 70), (3, "district", None, "Coded later", None, 71), (4, "state", "12", "Other level", None, None)], "id bigint, level string, lgd_code string, name_en string, parent_id bigint, osm_relation_id bigint")
    read = spark.createDataFrame([(60, "district", "12", "New name", None), (61, "district", "12", "Second", 8), (70, "district", "99", "X", 7), (71, "district", "44", "Y", None)], "osm_relation_id bigint, level string, lgd_code string, name string, parent_id bigint")
    got = {tuple(r) for r in boundaries.loaded(held, read).collect()}
    assert got == {
        (1, "district", "12", "Old", 9, 60, "updated"), (2, "district", "13", "Held", 7, 70, "updated"), (3, "district", "44", "Coded later", None, 71, "updated"), (4, "state", "12", "Other level", None, None, "kept"),
        (5, "district", "12", "Second", 8, 61, "inserted"),
    }
