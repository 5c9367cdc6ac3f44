"""Simplification with shared lines: neighbours meet, nothing collapses or crosses, odd rings stay."""

from __future__ import annotations

import random
from collections import Counter

from ledgerloom.operators import arcs

SCHEMA = "id long, level string, points array<struct<lon:double,lat:double>>, at string"


def run(spark, rings, tolerance, layer=None):
    rows = [(i, (layer or {}).get(i, "district"), None if ring is None else [tuple(map(float, p)) for p in ring], "other") for i, ring in rings.items()]
    got = arcs.simplified(spark.createDataFrame(rows, SCHEMA), tolerance, ["id"])
    assert got.columns == ["id", "level", "points", "at"]
    return {r.id: None if r.points is None else [tuple(p) for p in r.points] for r in got.collect()}


def sides(ring):
    return [tuple(sorted(s)) for s in zip(ring, ring[1:])]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def crosses(s, t):
    """Whether two sides meet anywhere but at a common end, by plain arithmetic."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    common = set(s) & set(t)
    if len(common) == 2:
        return False  # one side of two rings
    if common:
        p = common.pop()
        q, r = next(x for x in s if x != p), next(x for x in t if x != p)
        return turn(p, q, r) == 0 and (q[0] - p[0]) * (r[0] - p[0]) + (q[1] - p[1]) * (r[1] - p[1]) > 0
    boxes = all(max(s[0][k], s[1][k]) >= min(t[0][k], t[1][k]) and max(t[0][k], t[1][k]) >= min(s[0][k], s[1][k]) for k in (0, 1))
    return boxes and turn(*t, s[0]) * turn(*t, s[1]) <= 0 and turn(*s, t[0]) * turn(*s, t[1]) <= 0


def test_a_wiggly_border_is_one_line_for_both(spark):
    border = [(1, 0), (1.01, 0.25), (0.7, 0.5), (0.99, 0.75), (1, 1)]
    left = [(0, 0), *border, (0, 1), (0, 0)]
    right = [(2, 0), (2, 1), *reversed(border), (2, 0)]
    got = run(spark, {1: left, 2: right}, 0.15)
    assert (1, 0.75) not in got[1] and set(sides(got[1])) & set(sides(got[2])) == {((0.7, 0.5), (1, 0)), ((0.7, 0.5), (1, 1))}
    assert abs(area(got[1]) + area(got[2]) - 2) < 1e-12 and len(got[1]) == len(got[2]) == 6


def test_a_place_inside_a_hole_and_an_island_keep_their_rings(spark):
    octagon = [(2, 0), (4, 0), (6, 2), (6, 4), (4, 6), (2, 6), (0, 4), (0, 2), (2, 0)]
    hole = [(3, 2), (2, 3), (3, 4), (4, 3), (3, 2)]
    inner = [(4, 3), (3, 4), (2, 3), (3, 2), (4, 3)]  # the hole's line, other start, other way
    got = run(spark, {1: octagon, 2: hole, 3: inner, 4: [(x + 20, y) for x, y in octagon]}, 9.0)
    assert sorted(sides(got[2])) == sorted(sides(got[3])) and all(len(r) >= 4 and r[0] == r[-1] and area(r) != 0 for r in got.values())


def test_what_would_collapse_or_cross_gets_its_points_back(spark):
    sliver = [(0, 0), (1, 0.01), (2, 0), (1, -0.01), (0, 0)]
    north, south = [(0, 0), (1, 0.01), (2, 0), (2, 1), (0, 1), (0, 0)], [(0, 0), (1, -0.01), (2, 0), (2, -1), (0, -1), (0, 0)]
    got = run(spark, {1: sliver, 2: north, 3: south}, 0.1)
    assert sorted(sides(got[1])) == sorted(sides(sliver)) and (1, 0.01) in got[2] and (1, -0.01) in got[3]
    # an islet in a bay, whose mouth the straight line would cut off
    bay, islet = [(10, 0), (11, 0), (11.5, 0.4), (12, 0), (13, 0), (13, 5), (10, 5), (10, 0)], [(11.4, 0.1), (11.6, 0.1), (11.5, 0.2), (11.4, 0.1)]
    layers = {1: "a", 2: "b"}
    assert (11.5, 0.4) not in run(spark, {1: bay, 2: [(x, y - 3) for x, y in islet]}, 0.5)[1]
    raised = [(x, y - 0.15) for x, y in islet]  # it straddles the straight line
    assert (11.5, 0.4) in run(spark, {1: bay, 2: raised}, 0.5)[1] and (11.5, 0.4) not in run(spark, {1: bay, 2: raised}, 0.5, layers)[1]


def test_a_random_mosaic_stays_a_mosaic(spark):
    draw, n, lines = random.Random(3), 6, {}

    def line(a, b):
        """A crooked line between two corners, the same whoever asks."""
        key = tuple(sorted((a, b)))
        if key not in lines:
            (x0, y0), (x1, y1) = key
            across = (y1 - y0, x0 - x1)
            lines[key] = [key[0], *((x0 + (x1 - x0) * t / 8 + across[0] * d, y0 + (y1 - y0) * t / 8 + across[1] * d) for t in range(1, 8) for d in [draw.uniform(-0.12, 0.12)]), key[1]]
        return lines[key] if key[0] == a else lines[key][::-1]

    rings = {}
    for i in range(n):
        for j in range(n):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            whole = [p for a, b in zip(corners, corners[1:]) for p in line(tuple(map(float, a)), tuple(map(float, b)))[:-1]]
            turn = draw.randrange(len(whole))
            whole = whole[turn:] + whole[:turn]
            rings[i * n + j] = (whole + whole[:1])[:: draw.choice((1, -1))]
    for tolerance in (0.05, 0.3):
        got = run(spark, rings, tolerance)
        used = Counter(s for r in got.values() for s in set(sides(r)))
        outer = [s for s, k in used.items() if k == 1]
        degree = Counter(p for s in outer for p in s)
        assert set(used.values()) <= {1, 2} and set(degree.values()) == {2}  # the union has one closed outline, no gaps
        distinct = list(used)
        assert not any(crosses(s, t) for k, s in enumerate(distinct) for t in distinct[:k])
        assert sum(map(len, got.values())) < sum(map(len, rings.values())) and all(area(got[k]) * area(rings[k]) > 0 for k in rings)


def test_odd_rings_stay_and_empty_tables_are_empty(spark):
    odd = {1: None, 2: [], 3: [(0, 0), (1, 1), (0, 0)], 4: [(5, 5)] * 5, 5: [(0, 0), (1, 0), (1, 1), (0, 0)]}
    got = run(spark, odd, 0.5)
    assert got[1] is None and got[2] == [] and len(got[3]) == 3 and len(got[4]) >= 4 and sorted(sides(got[5])) == sorted(sides(odd[5]))
    none = arcs.simplified(spark.createDataFrame([], SCHEMA), 0.5, ["id"])
    assert none.count() == 0
