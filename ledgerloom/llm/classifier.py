"""Operator 6: quality classifier, a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters run over each
chunk, their outputs are max-pooled over the chunk, and one probability comes from the chunks' mean
pooled outputs. The first layer is a sum of table look-ups: a byte at each of WIDTH places picks a row.

The network is trained on at most TRAIN_ROWS labelled documents, half of each label where there are
enough of both, chosen by the hash of their ids, as far as TRAIN_BYTES of text go; all chunks of each are learned
from. Labels of held-out rows (crc32 of the id as text, modulo 3, is 1) are never read. Scoring takes whole texts.

Defined cases: a null or empty text is one chunk of padding; very long texts are scored whole, some chunks at a
time; without labels of both kinds every score is 0.5; a label that is null is no label; a row with a null id has a
score; of several labels of an id the smallest counts; repeated rows give a row each; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches, text_bytes

#: Fixed bounds of what training reads: labelled documents, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 1200, 8_000_000
#: Bytes of a chunk, bytes that neighbouring chunks share, places under a filter, filters.
CHUNK, OVERLAP, WIDTH, FILTERS = 512, 32, 5, 16
#: Passes over the training chunks, step size, weight decay.
EPOCHS, STEP, DECAY = 12, 0.01, 1e-4


@dataclass
class Network:
    """Look-up tables [WIDTH, 256, FILTERS] of the filters, their biases, and the last layer."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter outputs of each chunk, and where each maximum is."""
        out = self.table[0][chunks[:, : CHUNK - WIDTH + 1]]
        for k in range(1, WIDTH):
            out += self.table[k][chunks[:, k : CHUNK - WIDTH + 1 + k]]
        at = out.argmax(axis=1)
        top = np.take_along_axis(out, at[:, None, :], 1)[:, 0, :] + self.bias
        return top, at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of each text."""
        total, n = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        for owner, chunks in _chunk_groups(texts):
            top = np.maximum(self.pooled(chunks)[0], 0)
            np.add.at(total, owner, top)
            np.add.at(n, owner, 1)
        return _sigmoid(total / n[:, None] @ self.weight + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cut(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover the whole text; the last one is padded with zero bytes."""
    n = max(1, -(-max(0, len(text) - OVERLAP) // (CHUNK - OVERLAP)))
    padded = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


def _chunk_groups(texts: list[bytes], most: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    owners, rows, held = [], [], 0
    for i, text in enumerate(texts):
        chunks = cut(text)
        for a in range(0, len(chunks), most):
            part = chunks[a : a + most]
            owners.append(np.full(len(part), i))
            rows.append(part)
            held += len(part)
            if held >= most:
                yield np.concatenate(owners), np.concatenate(rows)
                owners, rows, held = [], [], 0
    if held:
        yield np.concatenate(owners), np.concatenate(rows)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 6) -> Network:
    """Train on whole chunks by Adam; each document's mean pooled outputs carry its label."""
    draw = np.random.default_rng(seed)
    net = Network(draw.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, FILTERS), 0.0)
    if len(set(labels.tolist())) < 2:
        net.weight = np.zeros(FILTERS)
        return net
    picked = [cut(t) for t in texts]
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.table, net.bias, net.weight]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    offset_moments, step = [0.0, 0.0], 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(texts))
        rate = STEP * (1 - epoch / EPOCHS)
        for a in range(0, len(order), 32):
            ids = order[a : a + 32]
            chunks = np.concatenate([picked[i] for i in ids])
            owner = np.repeat(np.arange(len(ids)), [len(picked[i]) for i in ids])
            top, at = net.pooled(chunks)
            live = np.maximum(top, 0)
            n = np.bincount(owner, minlength=len(ids))[:, None]
            mean = np.zeros((len(ids), FILTERS))
            np.add.at(mean, owner, live)
            mean /= n
            wrong = (_sigmoid(mean @ net.weight + net.offset) - labels[ids]) * cost[ids] / len(ids)
            back = ((wrong[:, None] * net.weight) / n)[owner] * (top > 0)
            grad_table = np.zeros_like(net.table)
            rows, filters = np.indices(at.shape)
            for k in range(WIDTH):
                np.add.at(grad_table[k], (chunks[rows, at + k], filters), back)
            grads = [grad_table + DECAY * net.table, back.sum(0), mean.T @ wrong + DECAY * net.weight]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
            g = wrong.sum()
            offset_moments = [0.9 * offset_moments[0] + 0.1 * g, 0.99 * offset_moments[1] + 0.01 * g * g]
            net.offset -= rate * offset_moments[0] / (1 - 0.9**step) / (np.sqrt(offset_moments[1] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from; a null id is not held out and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on a bounded sample of the labelled documents that are not held out; the same rows at every run."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(id_col, F.col(label_col).alias("_label"))
    known = known.groupBy(id_col).agg(F.min("_label").alias("_label"))
    by_hash = F.xxhash64(F.col(id_col), F.lit(6))
    half = TRAIN_ROWS // 2
    sample = None
    for label in (0, 1):  # two top-k sorts by a hash: bounded, and no window over a whole label
        part = known.where(F.col("_label") == label).orderBy(by_hash, id_col).limit(half)
        sample = part if sample is None else sample.unionByName(part)
    taken = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).withColumn("_hash", by_hash)
    lengths = taken.select("_hash", id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n")).orderBy("_hash", id_col, "n").limit(TRAIN_ROWS).collect()
    left, chosen = TRAIN_BYTES, set()
    for r in lengths:
        if r["n"] <= left:
            left -= r["n"]
            chosen.add((r[id_col], r["n"]))
    fits = F.struct(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    wanted = docs.sparkSession.createDataFrame(sorted(chosen), taken.select(fits.alias("f")).schema["f"].dataType)
    read = taken.join(F.broadcast(wanted.toDF(id_col, "_n")), [id_col]).where(F.coalesce(F.octet_length(text_col), F.lit(0)) == F.col("_n"))
    rows = read.orderBy("_hash", id_col, text_col).limit(TRAIN_ROWS).select(text_col, "_label").collect()
    return fit([(r[0] or "").encode("utf-8", "surrogatepass") for r in rows], np.array([r[1] for r in rows], float))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and score."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = net.scores(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
