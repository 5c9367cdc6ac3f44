"""Operator 8: near-duplicate documents by MinHash and an LSH forest.

1. Each document gets the set of its word shingles, as 64-bit hashes, and from it VALUES MinHash values
   and a one-bit sketch of them. Documents with the same set are one class, led by its smallest id.
2. The forest: TREES orders of the signature's values, DEPTH values each. Every class has a row in every
   tree; one global sort lines the rows up, and classes are candidates if they are neighbours that share
   a longest common prefix of ``least`` values, so that a crowd of m copies first gives about m candidates a
   tree. ``least`` grows with the logarithm of the number of classes.
3. Candidates whose sketches are too far apart for the threshold (by SKETCH_SIGMAS standard deviations) go.
4. The rest are confirmed on the full sets of both texts: first each class with its nearest smaller-id
   candidate; then, among the other candidates, all that still lie in different components.
5. Then the regions of the forest: all classes that share ``least`` values in a tree. A region of more than CROWD
   classes is deepened, value by value, until its parts are smaller or share all DEPTH values. First every class is
   compared with its region's hub, the class of most links. Then all classes of a region that still lie in different
   components and whose sizes and sketches allow a link are paired, so that a dense region hides no pair. These pairs are
   confirmed in squares: a task gets the texts of two squares of a region once, makes each one's set once and counts the
   pairs' common shingles, so texts don't move once a pair. A crowd just below the threshold has no links and costs pairs
   with the square of its size.
6. Links make components (see components.py); a class passes its component on to its members.

Chance of missing a link at exactly the threshold 0.8, by (1 - 0.8 ** depth) ** TREES: below 0.01 percent at depths
up to 6, 0.05 percent at 7 and 0.28 percent at 8, the depth of more than 2.7 * 10**8 classes and of the densest
regions; a little more since every value serves two trees, and less where other links connect its component.

Defined cases: documents without words or with a null text have no shingles and link with nothing;
a null id links with nothing and has a null component; rows that share an id are linked together; very long
texts are hashed whole, some shingles at a time; equal distances are ordered by id; empty tables give empty tables;
other columns are kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.text import binary_rows, bounded_batches, mix, text_bytes, word_hashes
from ledgerloom.session import Cut, cut

#: The signature: VALUES values of 16 bits; the forest: TREES orders of DEPTH of them.
VALUES, TREES, DEPTH = 128, 32, 8
#: Neighbours on one side that a row is first compared with in each tree; what these links leave apart is then paired whole.
REACH = 2
#: Classes of a region, and shingles of their texts, on each side of a square; one longer text is a square's whole side.
PAIRED_ROWS, PAIRED_SHINGLES = 200, 400_000
#: Classes of a region beyond which it is deepened, and rows of a class beyond which its leader goes to all tasks.
CROWD, HOT_ROWS = 2000, 1000
#: Most leaders that go to all tasks: some 10 MB. Beyond it their rows are joined as all others.
HOT_CLASSES = 100_000
#: Standard deviations by which a sketch may miss the threshold before a candidate goes unconfirmed.
SKETCH_SIGMAS = 4.5

_draw = np.random.default_rng(8)
_TIMES = _draw.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 2**63, VALUES, dtype=np.uint64)
#: The value order of each tree: TREES * DEPTH places in random permutations of all values.
_ORDERS = np.concatenate([_draw.permutation(VALUES) for _ in range(-(-TREES * DEPTH // VALUES))])[: TREES * DEPTH].reshape(TREES, DEPTH)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles of so many words; a shorter text is one shingle, an empty one none."""
    words, offsets = word_hashes([t.lower() for t in texts])  # bytes.lower() changes A to Z only
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = min(size, b - a)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = words[a : b - n + 1].copy()
        for k in range(1, n):
            h = h * _PAIR + words[a + k : b - n + 1 + k]
        out.append(np.unique(mix(h * _PAIR + np.uint64(n))))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a set: the least of each of VALUES hash orders, its high bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return mix(least)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(text_bytes(batch.column(1)), size)
            sums = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ _PAIR).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            full = [signature(s) for s in sets]
            values = np.array(full, np.uint64).reshape(-1, VALUES)
            bits = np.packbits((values & np.uint64(1)).astype(bool), axis=1).view(np.int64) if len(values) else np.empty((0, VALUES // 64), np.int64)
            columns = [batch.column(0), pa.array(map(len, sets), pa.int64()), *(pa.array(sums[:, i]) for i in (0, 1)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in (0, 1)), binary_rows((values >> np.uint64(48)).astype(">u2"))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_a", "set_b", "bits_a", "bits_b", "signature"])

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row in every tree for each class."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u2").reshape(n, VALUES)
        keys = np.ascontiguousarray(values[:, _ORDERS.ravel()]).reshape(n * TREES, DEPTH)
        repeat = lambda i: pa.array(np.repeat(batch.column(i).to_numpy(), TREES))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), binary_rows(keys), repeat(0), repeat(1), repeat(2), repeat(4)], ["tree", "prefix", "id", "bits_a", "bits_b", "size"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int32)


def _neighbours(least: int, most_bits: int):
    """Candidates from sorted rows: neighbours within REACH in one tree, a common prefix, near sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            tree, ids, a, b = (rows.column(i).to_numpy() for i in (0, 2, 3, 4))
            keys = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)
            low, high, far = [], [], []
            for step in range(1, REACH + 1):
                if len(ids) <= step:
                    continue
                same = (tree[step:] == tree[:-step]) & (keys[step:, :least] == keys[:-step, :least]).all(axis=1)
                distance = _popcount(a[step:] ^ a[:-step]) + _popcount(b[step:] ^ b[:-step])
                hit = np.flatnonzero(same & (distance <= most_bits))
                x, y = ids[hit], ids[hit + step]
                low.append(np.minimum(x, y))
                high.append(np.maximum(x, y))
                far.append(distance[hit])
            tail = rows.slice(max(0, rows.num_rows - REACH))
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (low, high, far)], ["a", "b", "far"])

    return run


def _confirmed(size: int, percent: int):
    """Pairs whose sets really are alike: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sets = shingle_sets(text_bytes(batch.column(2)) + text_bytes(batch.column(3)), size)
            ok = []
            for x, y in zip(sets[:n], sets[n:], strict=True):
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            chosen = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are alike."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(size, percent), "a bigint, b bigint").distinct()


def _confirmed_square(size: int, percent: int):
    """Pairs of one square whose sets really are alike. texts: the square's ids and texts, each one once; an id may have several."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets = shingle_sets(text_bytes(texts["text"].combine_chunks()), size)
        ends = np.cumsum([len(s) for s in sets])
        shingles, codes = np.unique(np.concatenate(sets), return_inverse=True)
        coded, of = np.split(codes, ends[:-1]), {}
        for i, key in enumerate(texts["id"].to_pylist()):
            of.setdefault(key, []).append(i)
        held, last, ok = [], None, []
        pairs = pairs.sort_by("a")
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            if a != last:
                held, last = [], a
                for x in of[a]:
                    holds = np.zeros(len(shingles), bool)
                    holds[coded[x]] = True
                    held.append((holds, len(coded[x])))
            alike = False
            for y in of[b]:
                for holds, n in held:
                    both = int(np.count_nonzero(holds[coded[y]]))
                    alike = alike or (both > 0 and 100 * both >= percent * (n + len(coded[y]) - both))
            ok.append(alike)
        return pairs.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _confirm_squares(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``_inside`` whose texts' sets are alike; each square is a group with its texts."""
    square = ["key", "square_x", "square_y"]
    within = [F.col(c).alias(f"{c}_t") for c in square]
    wanted = pairs.select(*within, F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select("key_t", "square_x_t", "square_y_t", "id", "text")
    return pairs.groupBy(*square).cogroup(wanted.groupBy("key_t", "square_x_t", "square_y_t")).applyInArrow(_confirmed_square(size, percent), "a bigint, b bigint")


#: Squares on each side of a region.
_SIDES = f"cast(greatest(ceil(n / {PAIRED_ROWS}), ceil(shingles / {PAIRED_SHINGLES})) AS int)"


def _near(x: str, y: str, most_bits: int, percent: int) -> str:
    """Whether the sizes (exactly) and the sketches of two classes allow a link, in SQL."""
    far = " + ".join(f"bit_count({x.format(bits)} ^ {y.format(bits)})" for bits in ("bits_a", "bits_b"))
    sizes = f"{x.format('size')}, {y.format('size')}"
    return f"100 * least({sizes}) >= {percent} * greatest({sizes}) AND {far} <= {most_bits}"


def _regions(forest: DataFrame, of: DataFrame, least: int, hold) -> DataFrame:
    """The rows of regions that hold more than one component: key, n (its classes), shingles (of all), id, sketch, size, of (the component).

    Regions share ``least`` values of a tree; those of more than CROWD classes are deepened until they are smaller or
    share DEPTH values. ``hold`` cuts the rows of each depth.
    """
    sketch = ["bits_a", "bits_b", "size"]
    rows = forest.join(of, "id", "left").select("tree", "prefix", "id", *sketch, F.coalesce("component", "id").alias("of"))
    settled = None
    for depth in range(least, DEPTH + 1):
        keyed = rows.withColumn("key", F.expr(f"xxhash64(tree, {depth}, substring(prefix, 1, {2 * depth}))"))
        totals = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("of").alias("low"), F.max("of").alias("high"))
        held = hold(keyed.join(totals.where("low < high").select("key", "n", "shingles"), "key"))
        done = held if depth == DEPTH else held.where(f"n <= {CROWD}")
        settled = done if settled is None else settled.unionByName(done)
        rows = held.where(f"n > {CROWD}").select("tree", "prefix", "id", *sketch, "of")
        if depth == DEPTH or rows.isEmpty():
            break
    return settled.select("key", "n", "shingles", "id", *sketch, "of")


def _still_apart(regions: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``regions`` with newer components, without the regions that are one component by now.

    Components only grow, so these are the rows that _regions would find again.
    """
    rows = regions.drop("of").join(of, "id", "left").withColumn("of", F.coalesce("component", "id")).drop("component")
    apart = rows.groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("key")
    return rows.join(apart, "key", "left_semi")


def _inside(regions: DataFrame, most_bits: int, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of a region that lie in different components and may be alike, each in one square.

    A region of one component makes no pairs; the rows of the others meet in squares, so that a large region is many
    tasks' work.
    """
    sized = regions.withColumn("sides", F.expr(_SIDES)).withColumn("own", F.expr("cast(pmod(xxhash64(id), sides) AS int)"))
    names = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "bits_a", "bits_b", "size", "of")]
    left = sized.select("key", F.col("own").alias("square_x"), *names("x"))
    right = sized.select("key", F.explode(F.expr("sequence(0, sides - 1)")).alias("square_x"), F.col("own").alias("square_y"), *names("y"))
    met = left.join(right, ["key", "square_x"]).where(f"id_x < id_y AND of_x != of_y AND {_near('{}_x', '{}_y', most_bits, percent)}")
    each = met.groupBy(F.col("id_x").alias("a"), F.col("id_y").alias("b")).agg(F.min(F.struct("key", "square_x", "square_y")).alias("at"))
    return each.select("a", "b", "at.*")


def _hubs(regions: DataFrame, links: DataFrame, most_bits: int, percent: int) -> DataFrame:
    """Pairs (a, b) of every class of a region with the region's hub, the class of most links, where components differ and a link may be.

    Copies of one original are often alike with it and not with each other: a pair a class links them. Each pair has a
    square of its region (key, square_x, square_y) and ``large``, whether the region has several, so that a large region's
    hub goes along once a square.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    hub = regions.join(degree, "id").groupBy("key").agg(F.max_by(F.struct("id", "bits_a", "bits_b", "size", "of"), F.struct("links", -F.col("id"))).alias("hub"))
    near = F.expr(f"of != hub.of AND {_near('{}', 'hub.{}', most_bits, percent)}")
    met = regions.join(hub, "key").where(near).withColumn("sides", F.expr(_SIDES))
    square = F.struct((F.col("sides") > 1).alias("large"), "key", F.expr("cast(pmod(xxhash64(id), sides) AS int)").alias("square_x"), F.lit(0).alias("square_y"))
    return met.groupBy(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).agg(F.min(square).alias("at")).select("a", "b", "at.*")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id reachable by links) and kept (it leads its component)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts: list[Cut] = []

    def hold(df: DataFrame) -> DataFrame:
        """Cut, until the components are written."""
        cuts.append(Cut(df))
        return cuts[-1].df

    signed = Cut(texts.mapInArrow(_signatures(shingle_words), "id bigint, n_shingles bigint, set_a bigint, set_b bigint, bits_a bigint, bits_b bigint, signature binary")).df
    members = signed.select("id", "n_shingles", "set_a", "set_b")
    leaders = members.where("n_shingles > 0 AND id IS NOT NULL").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("id"), F.count("*").alias("n_rows"))
    classes = hold(signed.join(leaders, ["n_shingles", "set_a", "set_b", "id"], "left_semi").select("id", "bits_a", "bits_b", "signature", "n_shingles"))

    many = classes.count()
    least = min(DEPTH, max(3, math.ceil(math.log(max(2, many)) / math.log(16))))
    differ = (1 - percent / 100) / 2  # chance that a sketch bit differs at the threshold
    most_bits = math.ceil(VALUES * differ + SKETCH_SIGMAS * math.sqrt(VALUES * differ * (1 - differ)))
    # enough ranges for the rows at hand; ids are part of the order, so a crowd with one prefix is split too
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many * TREES // 2_000_000)
    forest = classes.mapInArrow(_plant, "tree int, prefix binary, id bigint, bits_a bigint, bits_b bigint, size bigint")
    lined = forest.repartitionByRange(ranges, "tree", "prefix", "id").sortWithinPartitions("tree", "prefix", "id")
    candidates = hold(lined.mapInArrow(_neighbours(least, most_bits), "a bigint, b bigint, far int").where("a < b").groupBy("a", "b").agg(F.min("far").alias("far")))

    nearest = candidates.groupBy("b").agg(F.min(F.struct("far", "a")).alias("near")).select(F.col("near.a").alias("a"), "b")
    first = hold(_confirm(nearest, texts, shingle_words, percent))
    of = hold(connected_components(first))
    named = lambda side: of.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    open_pairs = candidates.join(nearest, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    apart = open_pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    second = _confirm(apart, texts, shingle_words, percent)
    linked = hold(first.unionByName(second))
    regions = hold(_regions(forest, hold(connected_components(linked)), least, hold))
    hubs = hold(_hubs(regions, linked, most_bits, percent).join(candidates.select("a", "b"), ["a", "b"], "left_anti"))
    few, large = hubs.where("NOT large").select("a", "b"), hubs.where("large").drop("large")
    by_hub = _confirm(few, texts, shingle_words, percent).unionByName(_confirm_squares(large, texts, shingle_words, percent))
    linked = hold(linked.unionByName(by_hub))
    apart = _still_apart(regions, hold(connected_components(linked)))
    hidden = hold(_inside(apart, most_bits, percent).join(candidates.select("a", "b"), ["a", "b"], "left_anti"))
    components = connected_components(linked.unionByName(_confirm_squares(hidden, texts, shingle_words, percent)))

    # a class has one row here, so no key is hot; the rows of large classes meet their leader without a shuffle
    named = cut(leaders.join(components, "id", "left").select("n_shingles", "set_a", "set_b", F.col("id").alias("leader"), "component", "n_rows"))
    for done in cuts:  # the result reads signed and named alone
        done.drop()
    of_class = ["n_shingles", "set_a", "set_b"]
    hot = named.where(f"n_rows > {HOT_ROWS}").drop("n_rows")
    if hot.limit(HOT_CLASSES + 1).count() <= HOT_CLASSES:
        rest = members.join(F.broadcast(hot), of_class, "left_anti").join(named.where(f"n_rows <= {HOT_ROWS}").drop("n_rows"), of_class, "left")
        found = members.join(F.broadcast(hot), of_class).unionByName(rest)
    else:
        found = members.join(named.drop("n_rows"), of_class, "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("id")).otherwise(F.coalesce("component", "leader"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return found.select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that lead their component, with all their columns; rows that share an id stay or go together."""
    verdict = near_duplicates(docs, shingle_words, percent, id_col, text_col)
    dropped = verdict.where(~F.col("kept")).select(F.col(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti")
