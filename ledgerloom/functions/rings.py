"""Boundaries from member ways, their label points and simplified outlines: helpers over Arrow batches.

These carry state along points, so they are pandas functions of one relation or ring at a time; Spark deals
the rows. A relation that can't be assembled gets a reason instead of rings.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
RING = T.ArrayType(POINT)


def close_rings(ways: list[list[tuple]]) -> list[list[tuple]]:
    """Chains ways at shared end points, in the order they come, until every chain is closed."""
    at: dict[tuple, list[int]] = defaultdict(list)
    for i, way in enumerate(ways):
        at[way[0]].append(i)
        at[way[-1]].append(i)
    used, rings = [False] * len(ways), []
    for i, way in enumerate(ways):
        if used[i]:
            continue
        used[i] = True
        ring = list(way)
        while ring[0] != ring[-1] or len(ring) < 3:
            follow = next((k for k in at[ring[-1]] if not used[k]), None)
            if follow is None:
                raise ValueError("member ways do not close into a ring")
            used[follow] = True
            other = ways[follow]
            ring += other[1:] if other[0] == ring[-1] else other[-2::-1]
        if len(ring) < 4:
            raise ValueError("ring has fewer than 3 points")
        rings.append(ring)
    if not rings:
        raise ValueError("no member ways with geometry")
    return rings


@F.pandas_udf(T.StructType([T.StructField("rings", T.ArrayType(RING)), T.StructField("reason", T.StringType())]))
def _assembled(listed: pd.Series) -> pd.DataFrame:
    rings, reasons = [], []
    for text in listed:
        members = [m.get("geometry") if isinstance(m, dict) and m.get("type") == "way" else m if isinstance(m, list) else None for m in json.loads(text or "[]")]
        lines = [[(float(p["lon"]), float(p["lat"])) for p in w] for w in members if w is not None and len(w) >= 2]
        try:
            rings.append([[{"lon": x, "lat": y} for x, y in ring] for ring in close_rings(lines)])
            reasons.append(None)
        except ValueError as refused:
            rings.append(None)
            reasons.append(str(refused))
    return pd.DataFrame({"rings": pd.Series(rings, dtype=object), "reason": pd.Series(reasons, dtype=object)})


def assembled(ways: Column | str) -> Column:
    """struct(rings, reason): rings of a relation's ways, or why there are none.

    ways: a column of arrays of points, or of a relation's members, of which those of type way are taken. They travel as
    JSON, because nested arrays of unequal lengths don't reach pandas.
    """
    return _assembled.asNondeterministic()(F.to_json(ways))  # so marked, it is evaluated once, in a step of its own


def _distance(ring: np.ndarray, x: float, y: float) -> float:
    """Distance from a point to a closed ring, negative outside."""
    a, b = ring[:-1], ring[1:]
    d = b - a
    length = (d * d).sum(axis=1)
    t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.where(length > 0, length, 1), 0, 1)
    near = np.sqrt(((a + t[:, None] * d - (x, y)) ** 2).sum(axis=1)).min()
    crossing = (a[:, 1] > y) != (b[:, 1] > y)
    at = d[:, 0] * (y - a[:, 1]) / np.where(d[:, 1] != 0, d[:, 1], 1) + a[:, 0]
    return near if (crossing & (x < at)).sum() % 2 else -near


def inscribed(ring: np.ndarray, precision: float = 1e-4) -> tuple[float, float]:
    """The centre of the largest circle inside a ring: cells are halved where they may still hold a better one."""
    (w, s), (e, n) = ring.min(axis=0), ring.max(axis=0)
    size = max(min(e - w, n - s), 1e-12)
    heap: list[tuple] = []

    def push(x: float, y: float, half: float) -> None:
        d = _distance(ring, x, y)
        heapq.heappush(heap, (-(d + half * np.sqrt(2)), d, x, y, half))

    for x in np.arange(w, e, size):
        for y in np.arange(s, n, size):
            push(x + size / 2, y + size / 2, size / 2)
    best = max(heap, key=lambda c: c[1])[1:4]
    while heap:
        bound, d, x, y, half = heapq.heappop(heap)
        if d > best[0]:
            best = (d, x, y)
        if -bound - best[0] <= precision * size:
            break
        for dx in (-half / 2, half / 2):
            for dy in (-half / 2, half / 2):
                push(x + dx, y + dy, half / 2)
    return float(best[1]), float(best[2])


def thinned(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points an outline keeps so that no dropped one is farther than the tolerance from it; at least a triangle."""
    keep = np.zeros(len(ring), bool)
    far = int(((ring - ring[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, -1]] = True
    spans = [(0, far), (far, len(ring) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        line = ring[b] - ring[a]
        rest = ring[a + 1 : b] - ring[a]
        length = np.hypot(*line)
        off = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / length if length > 0 else np.hypot(rest[:, 0], rest[:, 1])
        at = int(off.argmax())
        if off[at] > tolerance:
            keep[a + 1 + at] = True
            spans += [(a, a + 1 + at), (a + 1 + at, b)]
    if keep.sum() < 4 <= len(ring):
        keep[np.flatnonzero(~keep)[: 4 - keep.sum()]] = True
    return keep


def _points(ring) -> np.ndarray | None:
    return None if ring is None or len(ring) < 4 else np.array([(p["lon"], p["lat"]) for p in ring])


@F.pandas_udf(POINT)
def label_point(rings: pd.Series) -> pd.DataFrame:
    """Where a name sits inside its place."""
    found = [(None, None) if (p := _points(r)) is None else inscribed(p) for r in rings]
    return pd.DataFrame(found, columns=["lon", "lat"], dtype="float64")


def simplified(tolerance: float):
    """A pandas UDF that thins rings to a tolerance in degrees."""

    @F.pandas_udf(RING)
    def thin(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else list(r) if (p := _points(r)) is None else [{"lon": x, "lat": y} for x, y in p[thinned(p, tolerance)].tolist()])

    return thin
