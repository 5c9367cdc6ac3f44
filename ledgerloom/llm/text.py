"""Helpers that several operators share inside their tasks: words, word hashes, Arrow batches.

A word is a maximal run of characters other than space and U+0009 to U+000D. ``bytes.split()``
splits UTF-8 at exactly those six bytes, so the byte view and the text view agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows in an Arrow batch, so that a batch of very long texts still fits in a worker.
BATCH_ROWS = 500
#: Bytes of text that are hashed in one numpy pass.
PIECE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session at BATCH_ROWS rows or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash_buffer(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of every word in a buffer."""
    inner = ~_SPACE[buf]
    if not inner.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate(([False], inner, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    terms = _BYTE[buf[inner]] * powers(int(_BASE), int(lengths.max()))[within]
    return mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cut a text at white space into pieces of about PIECE_BYTES; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the n + 1 offsets of the texts in them."""
    counts, parts, group, size = np.zeros(len(texts) + 1, np.int64), [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            joined = b"\n".join(texts[i] for i in group)
            h, starts = _hash_buffer(np.frombuffer(joined, np.uint8))
            begins = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
            cuts = np.searchsorted(starts, begins)
            counts[np.array(group) + 1] = np.diff(cuts)
            parts.append(h)
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            flush()
            for piece in _pieces(text):
                h, _ = _hash_buffer(np.frombuffer(piece, np.uint8))
                counts[i + 1] += len(h)
                parts.append(h)
            continue
        if size + len(text) > PIECE_BYTES:
            flush()
        group.append(i)
        size += len(text) + 1
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(counts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_rows(values: np.ndarray) -> pa.Array:
    """A two-dimensional numpy array as a binary column, one value for each row."""
    values = np.ascontiguousarray(values)
    width, n = values.dtype.itemsize * values.shape[1], values.shape[0]
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])
