"""Operator 2: nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to the mean of all, scaled to length one and turned by a random rotation; its
code is the sign bit of each turned component. Two scalars go with a code: the vector's length, and the
inner product of the turned vector with its own code. From packed bits and scalars comes an unbiased
estimate of the inner product with a query and an error bound that holds with high probability, so each
distance lies between a lower and an upper bound. A vector is reranked by its exact distance only if its
lower bound does not exceed the k-th smallest upper bound, or exact distance, that its query has met so far.

Every row is indexed: the codes are made in the tasks that hold the vectors, and vectors never move. The
queries go to the tasks in blocks of a fixed number of rows. Each task returns its own k best of each query,
and these few rows are ranked over all tasks.

Defined cases: null, zero and non-finite vectors, and those with a null id or component, take no part;
vectors of another length than the query's are no candidates; a repeated row counts as often as it is
there, but a row with the query's own id never; equal distances are ordered by id; fewer candidates than k are all
returned; empty tables give empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import Cut

#: Queries that go to the tasks at once, and that meet a piece of vectors at once.
BLOCK, STEP = 16_384, 512
#: Vectors of a batch that meet a step's queries at once, and pairs whose exact distances are held at once.
PIECE, PAIRS = 4096, 100_000
#: Standard deviations of the estimate that the bounds allow for.
EPSILON = 3.0
SEED = 2


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same at every call."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths from the centre, and inner products of the turned unit vectors with their codes."""
    rest = vectors - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = rest / np.where(length > 0, length, 1)[:, None] @ turn.T
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def set_bit_sums(bits: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Sums of the queries' components at the set bits [vectors, queries], one look-up a packed byte.

    The table of a byte has the sum of each query's eight components for all 256 values; codes stay packed.
    """
    queries, size = turned.shape
    padded = np.zeros((queries, 8 * bits.shape[1]), np.float32)
    padded[:, :size] = turned
    sums = np.zeros((len(bits), queries), np.float32)
    for k in range(bits.shape[1]):
        sums += (_BYTE_BITS @ padded[:, 8 * k : 8 * k + 8].T)[bits[:, k]]
    return sums


def bounds(bits: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances [vectors, queries]."""
    size = queries.shape[1]
    rest = queries - centre
    far = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest @ turn.T).astype(np.float32)
    # codes are plus or minus one over the root of the size: twice the sum over set bits less the sum over all
    product = (2 * set_bit_sums(bits, turned) - turned.sum(axis=1)) / np.float32(np.sqrt(size))
    own = np.maximum(own, 1e-6).astype(np.float32)[:, None]
    estimate = product / own * length.astype(np.float32)[:, None]
    slack = np.sqrt(np.maximum(1 - own**2, 0)) / own * np.float32(EPSILON / np.sqrt(max(1, size - 1)))
    slack = slack * (length.astype(np.float32)[:, None] * far.astype(np.float32)[None, :])
    base = (length**2).astype(np.float32)[:, None] + (far**2).astype(np.float32)[None, :]
    rounding = base * np.float32(1e-5)
    return base - 2 * (estimate + slack) - rounding, base - 2 * (estimate - slack) + rounding


class _Best:
    """The k best of each query so far in one task: exact distance, then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.limit = np.full(n, np.inf)
        self.query, self.vector, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> None:
        query, vector, score = (np.concatenate(x) for x in ((self.query, query), (self.vector, vector), (self.score, score)))
        order = np.lexsort((vector, score, query))
        query = query[order]
        begins = np.searchsorted(query, np.arange(len(self.limit)))
        rank = np.arange(len(query)) - begins[query]
        keep = rank < self.k
        self.query, self.vector, self.score = query[keep], vector[order][keep], score[order][keep]
        last = rank[keep] == self.k - 1
        self.limit[self.query[last]] = self.score[last]


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _sound(vectors: np.ndarray) -> np.ndarray:
    return np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)


def _of_size(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == size)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _centre(vectors: DataFrame, size: int) -> np.ndarray:
    """The mean of all sound vectors; what is collected has one row a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for batch in batches:
            v = _matrix(batch.column(1), size)
            v = v[_sound(v)]
            total += v.sum(axis=0)
            n += len(v)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64())], ["place", "total", "n"])

    rows = vectors.mapInArrow(run, "place int, total double, n bigint").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    centre = np.zeros(size)
    for r in rows:
        centre[r["place"]] = r["total"] / max(1, r["n"])
    return centre


def build_index(df: DataFrame, size: int, centre: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every sound vector with its code and scalars: id, v, bits, length, own."""
    turn = rotation(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), size)
            good = _sound(v)
            chosen = batch.filter(pa.array(good))
            bits, length, own = encode(v[good], centre, turn)
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(own)], ["id", "v", "bits", "length", "own"])

    return _of_size(df, id_col, vector_col, size).mapInArrow(run, "id bigint, v array<double>, bits binary, length double, own double")


def _search_block(index: DataFrame, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int) -> DataFrame:
    """The k best of each query of the block in each task."""
    size = queries.shape[1]
    shared = index.sparkSession.sparkContext.broadcast((ids, queries))
    turn = rotation(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = [_Best(len(ids[a : a + STEP]), k) for a in range(0, len(ids), STEP)]
        for whole in batches:
            for batch in (whole.slice(c, PIECE) for c in range(0, whole.num_rows, PIECE)):
                own_ids = batch.column(0).to_numpy()
                v = _matrix(batch.column(1), size)
                bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(v), -1)
                length, own = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                for a, held in zip(range(0, len(ids), STEP), best, strict=True):
                    q, qid = queries[a : a + STEP], ids[a : a + STEP]
                    low, high = bounds(bits, length, own, q, centre, turn)
                    self_pair = own_ids[:, None] == qid[None, :]
                    low[self_pair] = np.inf
                    high[self_pair] = np.inf
                    limit = held.limit**2 * (1 + 1e-9)
                    if len(v) >= k:
                        limit = np.minimum(limit, np.partition(high, k - 1, axis=0)[k - 1])
                    at, of = np.nonzero((low <= limit) & ~self_pair)
                    for b in range(0, len(at), PAIRS):
                        x, y = at[b : b + PAIRS], of[b : b + PAIRS]
                        gap = v[x] - q[y]
                        score = np.sqrt((gap * gap).sum(axis=1))
                        near = score <= held.limit[y]
                        if near.any():
                            held.add(y[near], own_ids[x[near]], score[near])
        for a, held in zip(range(0, len(ids), STEP), best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + STEP][held.query]), pa.array(held.vector), pa.array(held.score)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of df found for each query: query_id, rank, vec_id, score (Euclidean distance)."""
    found = None
    sizes = [r[0] for r in queries.where(F.size(vector_col) > 0).select(F.size(vector_col)).distinct().collect()]
    for size in sorted(sizes):
        asked = _of_size(queries, id_col, vector_col, size).dropDuplicates()
        blocks = max(1, -(-asked.count() // (BLOCK * 3 // 4)))
        centre = _centre(_of_size(df, id_col, vector_col, size), size)
        index = build_index(df, size, centre, id_col, vector_col)
        if blocks > 1:
            index = Cut(index).df
        for block in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).limit(BLOCK + 1).toArrow()
            if rows.num_rows > BLOCK:
                raise ValueError("a block of queries is larger than its bound")
            q = _matrix(rows["v"].combine_chunks().chunk(0) if isinstance(rows["v"].combine_chunks(), pa.ChunkedArray) else rows["v"].combine_chunks(), size) if rows.num_rows else np.empty((0, size))
            good = _sound(q)
            part = _search_block(index, rows["id"].to_numpy()[good], q[good], centre, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: queries are the rows whose id is divisible by 100."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
