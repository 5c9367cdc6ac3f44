"""Operator 4: substring dedup by Rabin-Karp hashes of every fixed-length token window.

A word goes if a window of WIDTH words of one document covers it whose word sequence also starts in a
document with a smaller id. Three steps, with the texts shuffled once:

1. Documents are dealt to chunks by ranges of their ids, so that chunk order is id order. Each chunk
   hashes all its windows (prefix sums of a polynomial, so that any window costs two look-ups) and sends
   each distinct hash once, packed by bucket: a passage that fills a chunk costs as much as one copy.
2. Each bucket of hashes sorts what all chunks sent and counts the chunks of each hash. All but the
   first chunk of a hash get a bit back that says: an earlier chunk has it, so some smaller id has.
3. Each chunk meets its bits, settles what repeats inside it by the smallest id there, and merges the
   repeated windows into maximal intervals of words to remove.

A hash has 64 bits besides its bucket, which an independent hash chooses. At 10**6 windows a bucket the
chance that a given window meets a false equal is below 10**-12, whatever the size of the corpus.

Defined cases: a null text has no words; a document with a null id is kept whole and repeats nothing;
rows that share an id count as one document for the rule and give a row each; empty tables give empty
tables; other columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches, mix, powers, text_bytes, word_hashes

WIDTH = 13
#: Bytes of text in a chunk grow with the root of the whole, between these bounds: so do hashes in a bucket.
CHUNK_BYTES = (4 << 20, 256 << 20)
_ROOT_FACTOR = 150
#: Two odd bases: of the hash that is compared, and of the one that deals hashes to buckets.
_KEY_BASE, _DEAL_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def window_hashes(words: np.ndarray, offsets: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of the windows at the given starts' documents, for every start where a window fits."""
    n = len(words)
    up = powers(base, n + 1)
    down = powers(pow(base, -1, 1 << 64), n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * up[:n], dtype=np.uint64)))
    starts = window_starts(offsets, width)
    return mix((sums[starts + width] - sums[starts]) * down[starts])


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Places at which a window of the given width fits inside its document."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    firsts = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(offsets[:-1] - firsts, counts)


class Chunk:
    """The windows of one chunk of documents, in the order that both passes over it share."""

    def __init__(self, ids: pa.Array, texts: pa.Array, width: int, buckets: int):
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((values, ~missing))  # null ids first, then by id
        self.texts = text_bytes(texts.take(pa.array(order, pa.int64())))
        self.nulls = nulls = int(missing.sum())
        self.ids = values[order][nulls:]
        words, offsets = word_hashes(self.texts)
        self.offsets = offsets
        compared = offsets[nulls:]  # documents without an id take no part
        self.starts = window_starts(compared, width)
        keys = window_hashes(words, compared, width, _KEY_BASE)
        deal = window_hashes(words, compared, width, _DEAL_BASE)
        del words
        by_key = np.argsort(keys, kind="stable")
        ordered = keys[by_key]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        self.by_key, self.first = by_key, first
        self.keys = ordered[first]
        bucket = (deal[by_key[first]] >> np.uint64(8)) % np.uint64(buckets)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.by_bucket].astype(np.int64)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket's number and the places of its hashes among the distinct ones."""
        numbers, begins = np.unique(self.bucket, return_index=True)
        yield from zip(numbers.tolist(), np.split(self.by_bucket, begins[1:]), strict=len(numbers) > 0)

    def repeated(self, seen_before: np.ndarray) -> np.ndarray:
        """Which window starts repeat a document with a smaller id: of an earlier chunk, or of this one."""
        group = np.cumsum(self.first) - 1
        owner = np.searchsorted(self.offsets[self.nulls :], self.starts[self.by_key], side="right") - 1
        owner_id = self.ids[owner]
        smallest = owner_id[self.first]  # windows of a hash keep their order, which is id order
        hit = np.zeros(len(self.by_key), bool)
        hit[self.by_key] = seen_before[group] | (owner_id > smallest[group])
        return hit


def _intervals(hits: np.ndarray, starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Maximal intervals [start, end) that repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[hits], 1)
    np.add.at(edge, starts[hits] + width, -1)
    covered = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    return np.flatnonzero(np.diff(covered.view(np.int8))).reshape(-1, 2)


def _boundaries(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, list[int]]:
    """The number of chunks and the ids at which chunks after the first begin."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    per_chunk = min(max(CHUNK_BYTES[0], int(math.sqrt(size) * _ROOT_FACTOR)), CHUNK_BYTES[1])
    chunks = max(1, math.ceil(size / per_chunk))
    if chunks == 1:
        return 1, []
    shares = [i / chunks for i in range(1, chunks)]
    cuts = docs.agg(F.percentile_approx(id_col, shares, max(10_000, 20 * chunks))).first()[0] or []
    return chunks, sorted(set(cuts))


def _chunk_of(cuts: list[int], id_col: str) -> F.Column:
    """How many cuts are at or below the id, by halving: log2 steps however many chunks there are."""
    steps = len(cuts).bit_length()
    padded = F.lit(cuts + [2**63 - 1] * ((1 << steps) - len(cuts)))
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(padded, at + half - 1) <= F.col(id_col), at + half).otherwise(at))
    return F.when(F.col(id_col).isNotNull(), found)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, the kept words joined by one space, and the removed intervals of word places."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    chunks, cuts = _boundaries(docs, id_col, text_col)
    buckets = chunks
    chunk = F.coalesce(_chunk_of(cuts, id_col) if cuts else F.lit(0), F.pmod(F.xxhash64(text_col), F.lit(chunks)).cast("int"))
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), chunk.alias("chunk")).repartition(chunks, "chunk")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = Chunk(_one(table["id"]), _one(table["text"]), width, buckets)
        numbers, packed = [], []
        for number, places in c.parts():
            numbers.append(number)
            packed.append(c.keys[places].tobytes())
        return pa.table({"bucket": pa.array(numbers, pa.int64()), "sender": pa.array([key[0].as_py()] * len(packed), pa.int32()), "hashes": pa.array(packed, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        senders = table["sender"].to_numpy()
        order = np.argsort(senders, kind="stable")
        packed = table["hashes"].to_pylist()
        arrays = [np.frombuffer(packed[i], np.uint64) for i in order]
        values = np.concatenate(arrays)
        by_value = np.argsort(values, kind="stable")  # equal hashes stay in the order of their chunks
        later = np.zeros(len(values), bool)
        ordered = values[by_value]
        later[by_value[1:]] = ordered[1:] == ordered[:-1]
        at, out = 0, []
        for i, a in zip(order, arrays, strict=True):
            bits = later[at : at + len(a)]
            at += len(a)
            if bits.any():
                out.append((int(senders[i]), key[0].as_py(), np.packbits(bits).tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int64()), "bits": pa.array(columns[2], pa.binary())})

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        c = Chunk(_one(left["id"]), _one(left["text"]), width, buckets)
        bits = dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True))
        before = np.zeros(len(c.keys), bool)
        for number, places in c.parts():
            if number in bits:
                before[places] = np.unpackbits(np.frombuffer(bits[number], np.uint8), count=len(places)).astype(bool)
        spans = _intervals(c.repeated(before), c.starts, width, int(c.offsets[-1]))
        n_words, removed, kept, intervals = [], [], [], []
        ids = [None] * c.nulls + c.ids.tolist()
        owner = np.searchsorted(c.offsets, spans[:, 0], side="right") - 1
        by_doc = np.searchsorted(owner, np.arange(len(c.texts) + 1))
        for i, text in enumerate(c.texts):
            words = text.split()
            # a window ends inside its document, but intervals of neighbouring documents may touch
            mine = [(a - c.offsets[i], b - c.offsets[i]) for a, b in _clip(spans, by_doc, i, c.offsets)]
            n_words.append(len(words))
            removed.append(sum(b - a for a, b in mine))
            for a, b in reversed(mine):
                del words[a:b]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            intervals.append([{"start": int(a), "end": int(b)} for a, b in mine])
        item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "intervals": pa.array(intervals, item)})

    sent = dealt.groupBy("chunk").applyInArrow(send, "bucket bigint, sender int, hashes binary")
    bits = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket bigint, bits binary")
    done = dealt.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(settle, "id bigint, n_words bigint, n_removed bigint, kept string, intervals array<struct<start:int,end:int>>")
    return done.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept", "intervals")


def _clip(spans: np.ndarray, by_doc: np.ndarray, i: int, offsets: np.ndarray) -> list[tuple[int, int]]:
    """The parts of the intervals that lie in document i, also of one that began in an earlier document."""
    a, b = int(offsets[i]), int(offsets[i + 1])
    out = []
    first = int(by_doc[i])
    while first > 0 and spans[first - 1, 1] > a:
        first -= 1
    for s, e in spans[first : int(by_doc[i + 1])].tolist():
        if (s := max(s, a)) < (e := min(e, b)):
            out.append((s, e))
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
