"""Operator 11: periodic runs by enumeration of maximal pairs.

A run is a stretch of words with smallest period q, at least max(MIN_WORDS, 3 * q) words long, that no
neighbouring word extends keeping q. Two equal stretches at distance q that differ in the word before and in
the word after are a maximal pair; if their length l is at least 2 * q and l + q at least MIN_WORDS, the
stretch from the first one's start to the second one's end is such a run, and nothing needs to be extended.

Each document is settled in one task, by itself:

1. Places whose next DEPTH words occur twice or more in the document are found by one sort of window hashes:
   2 * q <= l and l + q >= MIN_WORDS leave no pair shorter than DEPTH. All other places are done with.
2. Prefix doubling over those places, and the words that their windows and the next ones hold, puts them in
   suffix order; common prefixes follow by one walk over the places in text order.
3. The LCP-interval tree is climbed bottom-up on a stack. A node holds its places in order and, by left word,
   in class lists. Where two children meet, each place of the smaller one looks for partners of another class
   no further away than half the node's depth. Occurrences of a word that near each other lie in steps of its
   period, and all but the first have the same left word. So the first place in the window before and the class
   of the next place after it decide; at most one partner comes of each.
4. A stretch found at several distances keeps the smallest, which is its period.

Words and windows are compared as 64-bit hashes (a document of a million words meets a false equal with
a probability of 3 * 10**-8); each run is then confirmed word by word on those hashes.

Defined cases: a null or blank text has no words, no runs and empty digests; very long texts are settled whole,
with memory in proportion; equal exponents go to the smallest start, then period; a null id leaves the words
as they are; repeated rows give a row each; empty tables give empty tables; other columns are kept out.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.substring import window_hashes, window_starts
from ledgerloom.llm.text import bounded_batches, mix, text_bytes, word_hashes

#: The shortest run in words; the shortest maximal pair that can make one.
MIN_WORDS = 24
DEPTH = MIN_WORDS * 2 // 3
#: Words of the documents that are searched together; a longer document is searched alone.
GROUP_WORDS = 400_000
_BASE = 0xD6E8FEB86659FD93

Run = tuple[int, int, int]


def repeated_places(words: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window of depth words occurs twice or more in their document, ascending, and the rank of each one's window."""
    starts = window_starts(offsets, depth)
    if not len(starts):
        return starts, starts
    owner = np.searchsorted(offsets, starts, side="right").astype(np.uint64)
    keys = mix(window_hashes(words, offsets, depth, _BASE) + owner * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    often = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, ordered = order[often], ordered[often]
    rank = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)]) - 1
    places = starts[order]
    by_place = np.argsort(places)
    return places[by_place], rank[by_place]


def suffix_order(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By ascending places with the rank of the word at each: where its suffix stands among theirs, by prefix doubling.

    A rank is the first place of its group in the order, so that a group that splits keeps the groups around it.
    Beyond a place that is not listed a suffix counts as ended: the order holds as far as listed places reach.
    """
    n, width = len(places), 1
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))[:n]
    level = np.empty(n, np.int64)
    level[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    open_ = np.arange(n)
    while len(open_):
        after = np.minimum(np.searchsorted(places, places[open_] + width), n - 1)
        second = np.where(places[after] == places[open_] + width, level[after], -1 - places[open_])
        by = np.lexsort((second, level[open_]))
        open_, second = open_[by], second[by]
        first = level[open_]
        new_group = np.concatenate(([True], first[1:] != first[:-1]))
        new = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(open_))
        level[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        sizes = np.diff(np.concatenate((np.flatnonzero(new), [len(open_)])))
        open_ = np.sort(open_[np.repeat(sizes > 1, sizes)])
        width *= 2
    return level


def common_prefixes(words: list[int], end: int, places: list[int], order: list[int], level: list[int], group: list[int], depth: int) -> list[int]:
    """By place in the order: how many words the place there shares with its predecessor; 0 where their windows differ."""
    out = [0] * len(order)
    k, before = 0, -2
    for i, place in enumerate(places):
        at = level[i]
        k = k - 1 if place == before + 1 and k > depth else depth
        before = place
        if not at or group[order[at - 1]] != group[i]:
            k = 0
            continue
        other = places[order[at - 1]]
        most = end - max(place, other)
        while k < most and words[place + k] == words[other + k]:
            k += 1
        out[at] = k
    return out


class Node:
    """The places below a node of the LCP-interval tree, in order, and by the word to their left."""

    __slots__ = ("classes", "order")

    def __init__(self, place: int, left: int):
        self.order = [place]
        self.classes = {left: [place]}


def _join(into: list[int], more: list[int]) -> None:
    if len(more) * 8 > len(into):
        into.extend(more)
        into.sort()
    else:
        for x in more:
            insort(into, x)


def meet(a: Node, b: Node, depth: int, left: list[int], found: list[tuple[int, int, int]]) -> Node:
    """Pairs (first place, second place, depth) of two children, no further apart than half the depth; both merged."""
    if len(a.order) < len(b.order):
        a, b = b, a
    half, order, classes = depth // 2, a.order, a.classes
    for x in b.order:
        mine = left[x]
        at = bisect_left(order, x - half)
        if at < len(order) and (y := order[at]) < x and left[y] != mine:
            same = classes[left[y]]
            for i in range(bisect_left(same, x - half), bisect_left(same, x)):
                found.append((same[i], x, depth))
        at = bisect_right(order, x)
        if at < len(order) and (y := order[at]) <= x + half and left[y] != mine:
            same = classes[left[y]]
            for i in range(bisect_right(same, x), bisect_right(same, x + half)):
                found.append((x, same[i], depth))
    _join(order, b.order)
    for word, places in b.classes.items():
        if word in classes:
            _join(classes[word], places)
        else:
            classes[word] = places
    return a


def maximal_pairs(suffixes: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Climb the LCP-interval tree of places in suffix order; pairs (first place, second place, common words)."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, Node]] = []
    last = len(suffixes) - 1
    for i, place in enumerate(suffixes):
        node = Node(place, left[place])
        down = lcp[i + 1] if i < last else 0
        while stack and stack[-1][0] > down:
            depth, above = stack.pop()
            node = meet(above, node, depth, left, found)
        if stack and stack[-1][0] == down:
            depth, above = stack.pop()
            node = meet(above, node, depth, left, found)
        if down:
            stack.append((down, node))
    return found


def find_runs(words: np.ndarray, places: np.ndarray, rank: np.ndarray, min_words: int = MIN_WORDS) -> list[Run]:
    """Runs (start, length, period) of one document, by start, then period; places and rank as repeated_places gives them."""
    if not len(places):
        return []
    depth = min_words * 2 // 3
    at, end = int(places[0]), len(words)
    # words that decide the order: of each window and, where two are equal, of the window after it
    edge = np.zeros(end + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + 2 * depth, end), -1)
    reached = np.flatnonzero(np.cumsum(edge[:-1]))
    stands = suffix_order(reached, np.unique(words[reached], return_inverse=True)[1])[np.searchsorted(reached, places)]
    order = np.argsort(stands)
    level = np.empty(len(places), np.int64)
    level[order] = np.arange(len(places))
    listed, near, ranks = places.tolist(), words[at:].tolist(), rank.tolist()
    moved = [p - at for p in listed]
    lcp = common_prefixes(near, end - at, moved, order.tolist(), level.tolist(), ranks, depth)
    left = [0, *near]  # left[p] is the word before p; equal words are equal numbers
    left[0] = int(words[at - 1]) if at else -1
    found: dict[tuple[int, int], int] = {}
    for i, j, common in maximal_pairs([moved[k] for k in order.tolist()], lcp, left):
        period = j - i
        if common >= 2 * period and common + period >= min_words:
            key = (i + at, common + period)
            found[key] = min(found.get(key, period), period)
    return sorted(((s, n, q) for (s, n), q in found.items() if np.array_equal(words[s : s + n - q], words[s + q : s + n])), key=lambda r: (r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place after the contract's change; None where all stay."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def repeats_of(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact exponent; then the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (c := r[1] * best[2] - best[1] * r[2]) > 0 or c == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def search(texts: list[bytes], changes: list[int | None]) -> Iterator[tuple[list[Run], list[bytes]]]:
    """The runs and the words of each text; changes has the number that the contract's change of words takes, or None."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) // 6 <= GROUP_WORDS):
            size += len(texts[end]) // 6
            end += 1
        words, offsets = word_hashes(texts[at:end])
        moves: list[np.ndarray | None] = []
        for i, h in enumerate(changes[at:end]):
            a, b = int(offsets[i]), int(offsets[i + 1])
            move = planted(b - a, h) if h is not None else None
            moves.append(move)
            if move is not None:
                words[a:b] = words[a:b][move]
        places, rank = repeated_places(words, offsets, DEPTH)
        cuts = np.searchsorted(places, offsets)
        for i, move in enumerate(moves):
            a, b = int(offsets[i]), int(offsets[i + 1])
            mine = slice(int(cuts[i]), int(cuts[i + 1]))
            split = texts[at + i].split()
            if move is not None:
                split = [split[k] for k in move.tolist()]
            yield find_runs(words[a:b], places[mine] - a, rank[mine]), split
        at = end


SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: bool = False) -> DataFrame:
    """One row a document: id, n_words, its runs, and the words that stay once each run is cut to its first period, joined by one space.

    With change, words are first moved as the contract of the registered query says, by the crc32 of the id.
    """
    return _mapped(docs, id_col, text_col, change, SCHEMA, lambda texts, found: [
        pa.array([len(w) for _, w in found], pa.int64()),
        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in found], _RUNS),
        pa.array([_kept(r, w).decode("utf-8", "surrogatepass") for r, w in found], pa.string()),
    ])


def _kept(runs: list[Run], words: list[bytes]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = repeats_of(runs, len(words)).tolist()
    return b" ".join([w for w, g in zip(words, gone, strict=True) if not g])


def _mapped(docs: DataFrame, id_col: str, text_col: str, change: bool, schema: str, columns) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            changes = [zlib.crc32(str(i).encode()) if change and i is not None else None for i in batch.column(0).to_pylist()]
            found = list(search(texts, changes))
            made = columns(texts, found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    names = [id_col, *(f.split()[0] for f in schema.split(", "))]
    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, with its change of words."""

    def columns(texts: list[bytes], found: list[tuple[list[Run], list[bytes]]]) -> list[pa.Array]:
        best = [strongest(r) for r, _ in found]
        numbers = [[len(r) for r, _ in found], *([b and b[k] for b in best] for k in range(3)), [b and 1000 * b[1] // b[2] for b in best]]
        listed = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r, _ in found]
        kept = [hashlib.sha256(_kept(r, w)).hexdigest() for r, w in found]
        return [*(pa.array(x, pa.int64()) for x in numbers), pa.array(listed), pa.array(kept)]

    schema = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, "doc_id", "text", True, schema, columns)
