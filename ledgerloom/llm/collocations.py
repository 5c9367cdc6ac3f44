"""Operator 13: phrase collocations from count streams in prefix and suffix order.

Phrases of up to LONGEST words inside pieces, per language, that occur MIN_COUNT times or more, scored by the cut
that divides them worst. Three parts:

1. Counts. A first pass over the texts adds up saturating counters of hashed phrases of one to SKETCHED words;
   the tasks' counters are summed by blocks and become one bit a counter: may reach MIN_COUNT. A second pass keeps
   a phrase only if its own counter's bit and those of the shorter phrases inside it are set (no phrase is more
   frequent than a part of it), counts what is left per task and sends it in compressed blocks, with phrases that
   begin alike side by side; buckets of blocks are added up as they come. The counters only save
   work: whatever they let through is counted whole, and what they stop can't reach MIN_COUNT. Their number grows
   with the words, up to COUNTERS[1]; beyond it more rare phrases are shuffled, and the result is the same.
2. Streams. The frequent phrases of all lengths, and each language's number of words as the empty phrase, form one
   table. It is cut into ranges of suffix order (last word first) and then of prefix order. A range also gets the
   few phrases that its first key begins with. In one walk over a sorted range, phrases of all lengths advance
   in lockstep: a stack holds the counts of the current phrase's own beginnings, so that left counts, right counts
   and the largest count of a one-word extension on either side are merged in without a hash table.
3. Scores, in whole numbers of any size, and each language's first TOP rows; Spark keeps TOP rows a task before it
   gathers a language.

A phrase inside a longer one that is as frequent goes. Some one-word extension is then as frequent too, so that
extensions by one word decide.

Phrases are told apart by 64-bit hashes inside one group of texts of a task (a false equal among a million has a
probability below 10**-7), and by their words everywhere else.

Defined cases: a null text is empty; a null language is `und`; repeated rows count each; rows with a null id count;
empty tables give empty tables; a language without a candidate has no row; very long texts count whole; equal scores
go by the larger count, then by the phrase's bytes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches, mix, powers, text_bytes
from ledgerloom.session import cut

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: A phrase goes if a longer one has this share of its count, in per cent.
COVERED_PERCENT = 100
#: Lengths of phrases that have counters; bounds of the counters of a length, and words to a counter between them.
SKETCHED, COUNTERS, WORDS_PER_COUNTER = 3, (1 << 20, 1 << 27), 32
#: Counters in a block, the unit that tasks send.
BLOCK = 1 << 16
#: Bytes of text that are counted together, phrases that a task holds before it sends them, and phrases of a range.
GROUP_BYTES, HELD_PHRASES, RANGE_ROWS = 4 << 20, 1_000_000, 100_000
#: Bounds of the buckets that phrases are added up in, and words to a bucket between them.
BUCKETS, WORDS_PER_BUCKET = (64, 4096), 1 << 21
#: Keys that the borders of one range are drawn from.
_KEYS_PER_RANGE = 32

_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE[list(b" \t")] = True
_OUTSIDE = _BREAK | _SPACE
_draw = np.random.default_rng(20250311)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The words of some texts: hash, number of the language, piece, and where each stands in the joined bytes."""

    def __init__(self, texts: list[bytes], langs: list[int], keys: list[int]):
        self.joined = b"\n".join(texts).lower()  # bytes.lower() moves A-Z alone
        buf = np.frombuffer(self.joined, np.uint8)
        inner = ~_OUTSIDE[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inner, [False])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = self.ends - self.starts
        firsts = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
        terms = _BYTE[buf[inner]] * powers(_BASE, int(lengths.max(initial=1)))[within]
        hashes = np.add.reduceat(terms, firsts) if len(firsts) else np.empty(0, np.uint64)
        self.piece = np.cumsum(_BREAK[buf], dtype=np.int32)[self.starts]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")
        self.lang = np.array(langs, np.int64)[owner]
        self.word = mix(hashes + lengths.astype(np.uint64) + mix(np.array(keys, np.uint64))[self.lang])

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the hash of the phrase that starts at each word, and whether it lies inside one piece."""
        h, n = self.word, len(self.word)
        for k in range(1, longest + 1):
            if k > 1:
                h = mix(h[: max(0, n - k + 1)] * _STEP + self.word[k - 1 :])
            yield k, h, self.piece[: len(h)] == self.piece[k - 1 :]

    def text(self, start: int, k: int) -> str:
        """The k words from one on, joined by one space."""
        return b" ".join([self.joined[a:b] for a, b in zip(self.starts[start : start + k].tolist(), self.ends[start : start + k].tolist(), strict=True)]).decode("utf-8", "replace")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Pieces]:
    """Texts with their languages, some MB at a time; a longer text is a group by itself. names gets the languages met."""
    keys: list[int] = []
    number: dict[str, int] = {}
    texts: list[bytes] = []
    langs: list[int] = []
    held = 0
    for batch in batches:
        for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if texts and held + len(text) > GROUP_BYTES:
                yield Pieces(texts, langs, keys)
                texts, langs, held = [], [], 0
            if lang not in number:
                number[lang] = len(names)
                names.append(lang)
                keys.append(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little"))
            texts.append(text)
            langs.append(number[lang])
            held += len(text)
    if texts:
        yield Pieces(texts, langs, keys)


def _maybe_frequent(docs: DataFrame, counters: int, min_count: int) -> dict[int, np.ndarray]:
    """For each sketched length, packed bits: whether a counter may reach min_count. counters / 8 bytes a length."""
    shift = np.uint64(64 - (counters.bit_length() - 1))
    kind = np.uint8 if min_count <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for pieces in _groups(batches, []):
            for k, h, fits in pieces.phrases(SKETCHED):
                into = held.setdefault(k, np.zeros(counters, kind))
                places, counts = np.unique((h[fits] >> shift).astype(np.int64), return_counts=True)
                into[places] = np.minimum(into[places] + counts, min_count)
        for k, all_counts in held.items():
            for block, some in enumerate(all_counts.reshape(-1, BLOCK)):
                at = np.flatnonzero(some)
                if len(at):
                    sparse = len(at) * 24 < BLOCK  # compressed counters take a bit or two each, places two bytes
                    sent = pa.compress(at.astype(np.uint16).tobytes() + some[at].tobytes() if sparse else some.tobytes(), codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([len(at) if sparse else BLOCK], pa.int32()), pa.array([sent], pa.binary())], ["k", "block", "filled", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, block, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                into = held.setdefault((k, block), np.zeros(BLOCK, np.uint32))
                size = np.dtype(kind).itemsize
                sent = pa.decompress(packed, n * (size + 2 * (n < BLOCK)), codec="zstd", asbytes=True)
                if n < BLOCK:
                    at = np.frombuffer(sent[: 2 * n], np.uint16)
                    into[at] = np.minimum(into[at] + np.frombuffer(sent[2 * n :], kind), min_count)
                else:
                    np.minimum(into + np.frombuffer(sent, kind), min_count, out=into)
        for (k, block), counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(counts >= min_count).tobytes()], pa.binary())], ["k", "block", "bits"])

    sent = docs.mapInArrow(count, "k int, block int, filled int, counts binary")
    summed = sent.repartition("k", "block").mapInArrow(add, "k int, block int, bits binary")
    out = {k: np.zeros(counters // 8, np.uint8) for k in range(1, SKETCHED + 1)}
    for row in summed.collect():
        at = row["block"] * BLOCK // 8
        out[row["k"]][at : at + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, f of every phrase of up to LONGEST words with f >= min_count; the empty phrase has the number of words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    counters = min(max(COUNTERS[0], 1 << (words // WORDS_PER_COUNTER).bit_length()), COUNTERS[1])
    buckets = min(max(BUCKETS[0], words // WORDS_PER_BUCKET), BUCKETS[1])
    shift = np.uint64(64 - (counters.bit_length() - 1))
    shared = spark.sparkContext.broadcast(_maybe_frequent(rows, counters, min_count))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: dict[int, _Held] = {}
        total: Counter = Counter()
        bits = shared.value
        for pieces in _groups(batches, names):
            for i, some in enumerate(np.bincount(pieces.lang, minlength=len(names)).tolist()):
                total[names[i]] += some
            before = None
            for k, h, fits in pieces.phrases(LONGEST):
                ok = fits if before is None else fits & before[:-1] & before[1:]
                if k in bits:
                    at = np.flatnonzero(ok)
                    place = h[at] >> shift
                    known = bits[k][(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                    ok = np.zeros(len(h), bool)
                    ok[at[known.astype(bool)]] = True
                before = ok
                pair = h if k <= 2 else pair
                starts = np.flatnonzero(ok)
                keys, first, n = np.unique(h[starts], return_index=True, return_counts=True)
                held.setdefault(k, _Held()).add(keys, pair[starts[first]], n, starts[first], pieces, k)
            if sum(len(x.keys) for x in held.values()) > HELD_PHRASES:
                yield from _blocks(held, names, buckets)
                held.clear()
        if held:
            yield from _blocks(held, names, buckets)
        live = [x for x in total if total[x]]
        yield _sent(0, pa.RecordBatch.from_arrays([pa.array(live, pa.string()), pa.array([""] * len(live), pa.string()), pa.array([total[x] for x in live], pa.int64())], ["lang", "phrase", "n"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = [], 0
        for batch in batches:
            for block in batch.column(1).to_pylist():
                tables.append(pa.ipc.open_stream(block).read_all())
                rows += tables[-1].num_rows
                if rows > HELD_PHRASES and len(tables) > 1:
                    tables = [_summed(tables)]
                    rows = tables[0].num_rows // 2  # sums anew once as many more have come
        if tables:
            every = _summed(tables)
            yield from every.filter((pc.field("n") >= min_count) | (pc.field("phrase") == "")).to_batches(max_chunksize=50_000)

    counted = rows.select("text", "lang").mapInArrow(count, "bucket int, block binary")
    return counted.repartition("bucket").mapInArrow(add, "lang string, phrase string, n bigint").withColumnRenamed("n", "f")


class _Held:
    """Phrases of one length that a task has met: hashes in order, hashes of their first two words, counts, languages and texts."""

    def __init__(self):
        self.keys, self.pair = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.n, self.lang, self.text = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

    def add(self, keys: np.ndarray, pair: np.ndarray, n: np.ndarray, starts: np.ndarray, pieces: Pieces, k: int) -> None:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.n[at[known]] += n[known]
        new, at, starts = ~known, at[~known], starts[~known]
        texts = np.empty(len(at), object)
        texts[:] = [pieces.text(i, k) for i in starts.tolist()]
        self.keys, self.pair, self.n = np.insert(self.keys, at, keys[new]), np.insert(self.pair, at, pair[new]), np.insert(self.n, at, n[new])
        self.lang, self.text = np.insert(self.lang, at, pieces.lang[starts]), np.insert(self.text, at, texts)


def _blocks(held: dict[int, _Held], names: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """The phrases as compressed blocks, one a bucket; phrases that begin with the same two words lie side by side."""
    pair, lang, text, n = (np.concatenate([getattr(x, name) for x in held.values()]) for name in ("pair", "lang", "text", "n"))
    bucket = ((pair >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pair, bucket))
    for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        block = pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang[places].tolist()], pa.string()), pa.array(text[places].tolist(), pa.string()), pa.array(n[places], pa.int64())], ["lang", "phrase", "n"])
        yield _sent(int(bucket[places[0]]), block)


def _sent(bucket: int, block: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block"])


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])


Key = tuple[str, ...]


def _key(lang: str, phrase: str, backwards: bool) -> Key:
    words = phrase.split(" ") if phrase else []
    return (lang, *(reversed(words) if backwards else words))


def _in_ranges(table: DataFrame, backwards: bool) -> DataFrame:
    """The table with the range of each row's key; rows that a range's first key begins with are also there as copies (own: false)."""
    parts = max(1, -(-table.count() // RANGE_ROWS))
    drawn = table.select("lang", "phrase").orderBy(F.xxhash64("lang", "phrase"), "lang", "phrase").limit(parts * _KEYS_PER_RANGE).collect() if parts > 1 else []
    keys = sorted(_key(*row, backwards) for row in drawn)
    borders = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, part, own = [], [], []
            for i, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
                key = _key(lang, phrase, backwards)
                mine = bisect_right(borders, key)
                take.append(i)
                part.append(mine)
                own.append(True)
                for at in range(mine, len(borders)):
                    if borders[at][: len(key)] != key:
                        break
                    take.append(i)
                    part.append(at + 1)
                    own.append(False)
            moved = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(part, pa.int32()), pa.array(own)], [*batch.schema.names, "part", "own"])

    columns = ", ".join(f"{name} {kind}" for name, kind in table.dtypes)
    return table.mapInArrow(deal, f"{columns}, part int, own boolean")


def _walk(keys: list[Key], counts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Over sorted keys: the counts of each key's own beginnings, shortest first, and its most frequent one-word extension."""
    shorter: list[list[int]] = [[] for _ in keys]
    longer = [0] * len(keys)
    stack: list[int] = []
    for i, key in enumerate(keys):
        while stack and key[: len(keys[stack[-1]])] != keys[stack[-1]]:
            stack.pop()
        shorter[i] = [counts[j] for j in stack]
        if stack and len(keys[stack[-1]]) == len(key) - 1:
            longer[stack[-1]] = max(longer[stack[-1]], counts[i])
        stack.append(i)
    return shorter, longer


def _covered(longer: int, f: int) -> bool:
    return 100 * longer >= COVERED_PERCENT * f


def _sorted_range(table: pa.Table, backwards: bool) -> tuple[list[int], list[Key], dict[str, list]]:
    columns = {name: table[name].to_pylist() for name in table.column_names}
    keys = [_key(lang, phrase, backwards) for lang, phrase in zip(columns["lang"], columns["phrase"], strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return order, [keys[i] for i in order], {name: [values[i] for i in order] for name, values in columns.items()}


def _with_ends(table: DataFrame) -> DataFrame:
    """The table in suffix order: each phrase with the counts of its last 0, 1, ... words, and whether a word before it covers it."""

    def walk(rows: pa.Table) -> pa.Table:
        _, keys, c = _sorted_range(rows, True)
        shorter, longer = _walk(keys, c["f"])
        ends = [s if own else None for s, own in zip(shorter, c["own"], strict=True)]
        return pa.table({"lang": pa.array(c["lang"], pa.string()), "phrase": pa.array(c["phrase"], pa.string()), "f": pa.array(c["f"], pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64())), "covered": pa.array([_covered(x, f) for x, f in zip(longer, c["f"], strict=True)])})

    walked = _in_ranges(table, True).groupBy("part").applyInArrow(walk, "lang string, phrase string, f bigint, ends array<bigint>, covered boolean")
    return walked.groupBy("lang", "phrase").agg(F.max("f").alias("f"), F.max("ends").alias("ends"), F.bool_or("covered").alias("covered"))


def _scored(table: DataFrame) -> DataFrame:
    """The table of _with_ends in prefix order: candidates with their worst cut, without those that a word on either side covers."""

    def walk(rows: pa.Table) -> pa.Table:
        _, keys, c = _sorted_range(rows, False)
        shorter, longer = _walk(keys, c["f"])
        out: dict[str, list] = {name: [] for name in ("l", "r", "n", "score")}
        covered = []
        for key, begins, more, f, ends, own, before in zip(keys, shorter, longer, c["f"], c["ends"], c["own"], c["covered"], strict=True):
            k, best = len(key) - 1, (None,) * 4
            if own and k >= 2:
                n = begins[0]
                score, j = min((1000 * f * n // (begins[j] * ends[k - j]), j) for j in range(1, k))
                best = (begins[j], ends[k - j], n, score)
            for name, value in zip(out, best, strict=True):
                out[name].append(value)
            covered.append(before or _covered(more, f))
        return pa.table({"lang": pa.array(c["lang"], pa.string()), "phrase": pa.array(c["phrase"], pa.string()), "a": pa.array(c["f"], pa.int64())} | {name: pa.array(v, pa.int64()) for name, v in out.items()} | {"covered": pa.array(covered, pa.bool_())})

    walked = _in_ranges(table, False).groupBy("part").applyInArrow(walk, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint, covered boolean")
    return walked.groupBy("lang", "phrase").agg(*(F.max(c).alias(c) for c in ("a", "l", "r", "n", "score")), F.bool_or("covered").alias("covered")).where("score IS NOT NULL AND NOT covered").drop("covered")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases, or all of them, by score, count and phrase."""
    table = cut(frequent_phrases(docs, min_count, text_col, lang_col))
    scored = _scored(cut(_with_ends(table)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language's rows meet in one task: no more than some times top of them
        salt = F.pmod(F.xxhash64("phrase"), F.lit(16))
        scored = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
