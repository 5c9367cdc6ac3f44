"""Operator 3: mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent from 0 to 1 and the results are scaled to sum 1:
exponent 1 keeps the shares, 0 makes all sources equal. The exponent is bisected to meet a target: an
entropy, as a part of the largest possible one, or the most times that a source may be repeated.

The weights, to a billionth, give each source a budget of tokens. It is met in passes over the source: each
pass goes through the source's blocks, and the documents inside a block, in an order of its own (both by
hash). Full passes take all documents, the last one takes documents while the tokens before them in the
pass are below what is left of the budget. Blocks bound what one task has to order: a source that holds a
third of all rows is many blocks, and only the blocks' sums are ordered by source.

Defined cases: a null source is the source ''; null and empty texts have no tokens: such documents come in
every full pass and in a last pass as far as it goes; without tokens at all every document comes once;
rows that share an id are taken alike; a row with a null id is dealt by its text; very long texts are counted whole;
equal draws are ordered by id, then tokens; empty tables give empty tables; ``mix`` returns the input's columns,
whatever their names, in the order of the mix: whole blocks in a partition, by their draw, and each block's documents by theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The default target: the part of the largest entropy that the mixed weights should have.
TARGET_ENTROPY = 0.95
#: Most times that a source may be gone through.
MAX_REPEATS = 4.0
#: Tokens of a block on average, and halvings of the exponent's interval.
BLOCK_TOKENS, HALVINGS = 100_000, 60
#: Most sources whose totals come to the driver: some 100 MB of names and numbers.
MAX_SOURCES = 1_000_000
_PARTS = 1_000_000_000
SEED = "mix"
_WORDS = "[^\\x20\\x09-\\x0D]+"


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised shares to the power of the exponent; sources without tokens have weight 0."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    scale = sum(raised.values())
    return {s: x / scale for s, x in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def solve(tokens: dict[str, int], target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> tuple[float, dict[str, float]]:
    """The largest exponent that reaches the entropy, raised as far as the repetition limit asks, and its weights.

    Entropy and the largest repetition both fall as the exponent grows, so both are bisected. At exponent 1
    nothing is repeated; where both targets can't be met the repetition limit wins.
    """
    total, live = sum(tokens.values()), sum(n > 0 for n in tokens.values())
    if not total:
        return 1.0, dict.fromkeys(tokens, 0.0)

    def bisect(met_at_low: bool, met) -> tuple[float, float]:
        """The last interval around the exponent at which a target that is met at one end is met no more."""
        low, high = 0.0, 1.0
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            low, high = (mid, high) if met(mid) == met_at_low else (low, mid)
        return low, high

    exponent = 1.0
    if target_entropy is not None:
        enough = lambda x: entropy(weights_at(tokens, x)) >= target_entropy * math.log(live)
        exponent = 1.0 if live < 2 or enough(1.0) else bisect(True, enough)[0]
    if max_repeats is not None:
        fits = lambda x: all(w * total <= max_repeats * tokens[s] for s, w in weights_at(tokens, x).items())
        exponent = exponent if fits(exponent) else max(exponent, bisect(False, fits)[1])
    return exponent, weights_at(tokens, exponent)


def counted(docs: DataFrame, text_col: str, source_col: str, *carried) -> DataFrame:
    """_source and _tokens (words) of the documents, with what is carried."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORDS)), F.lit(0)).cast("long")
    return docs.select(*carried, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), tokens.alias("_tokens"))


def source_tokens(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> dict[str, int]:
    """Tokens of each source; the number of sources is checked before anything is collected."""
    sums = counted(docs, text_col, source_col).groupBy("_source").agg(F.sum("_tokens").alias("n"))
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    return {r["_source"]: r["n"] for r in rows}


def _draw(*what) -> F.Column:
    """A 32-bit number from the MD5 of the parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *what).cast("binary")), 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: list[str] | None = None) -> DataFrame:
    """One row for each time that a document is taken.

    doc (the carried columns as a struct, so that their names clash with nothing), _source, _tokens, _pass,
    _block, and the numbers that order the blocks of a pass (_block_order) and a block's documents (_doc_order).
    """
    spark = docs.sparkSession
    carried = docs.columns if carried is None else carried
    totals = source_tokens(docs, text_col, source_col)
    total = sum(totals.values())
    _, weights = solve(totals, target_entropy, max_repeats)
    rows = []
    for s, n in sorted(totals.items()):
        budget = math.floor(weights[s] * _PARTS + 0.5) * total // _PARTS if total else 0
        full, rest = divmod(budget, n) if n else (1, 0)
        rows.append((s, full, rest, max(1, -(-n // BLOCK_TOKENS))))
    budgets = spark.createDataFrame(rows, "_source string, _full bigint, _rest bigint, _blocks bigint")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    each = counted(docs, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), F.col(id_col).alias("_id"), key.alias("_key"))
    dealt = each.join(F.broadcast(budgets) if len(rows) <= 10_000 else budgets, "_source")
    dealt = dealt.withColumn("_block", F.pmod(_draw(F.lit("block"), F.col("_key")), F.col("_blocks")))

    full = dealt.withColumn("_pass", F.explode(F.expr("CASE WHEN _full > 0 THEN sequence(1, _full) END")))
    # the last pass: sums of blocks give where each block begins, so only its own documents are ordered in it
    blocks = dealt.groupBy("_source", "_block", "_full").agg(F.sum("_tokens").alias("_n"))
    order = _draw(F.lit("order"), F.col("_source"), F.col("_block"), F.col("_full") + 1)
    # prefix sums in two levels: ranges of the order, then the blocks of a range, so that no task has all blocks of a source
    ordered = blocks.withColumn("_order", order).withColumn("_range", F.shiftright("_order", 20))
    ranges = ordered.groupBy("_source", "_range").agg(F.sum("_n").alias("_sum"))
    ranges = ranges.withColumn("_begun", F.sum("_sum").over(W.partitionBy("_source").orderBy("_range")) - F.col("_sum"))
    in_range = F.sum("_n").over(W.partitionBy("_source", "_range").orderBy("_order", "_block")) - F.col("_n")
    begun = ordered.withColumn("_in", in_range).join(ranges, ["_source", "_range"]).select("_source", "_block", (F.col("_begun") + F.col("_in")).alias("_before"))
    in_block = W.partitionBy("_source", "_block").orderBy("_draw", "_id", "_tokens").rowsBetween(W.unboundedPreceding, 0)
    last = dealt.where("_rest > 0").withColumn("_draw", _draw(F.lit("doc"), F.col("_key"), F.col("_full") + 1)).withColumn("_inside", F.sum("_tokens").over(in_block) - F.col("_tokens"))
    last = last.join(begun, ["_source", "_block"]).where("_before + _inside < _rest").withColumn("_pass", F.col("_full") + 1)
    columns = ["doc", "_key", "_source", "_tokens", "_block", "_pass"]
    taken = full.select(*columns).unionByName(last.select(*columns))
    return taken.withColumn("_block_order", _draw(F.lit("order"), F.col("_source"), F.col("_block"), F.col("_pass"))).withColumn("_doc_order", _draw(F.lit("doc"), F.col("_key"), F.col("_pass"))).drop("_key")


def mix(docs: DataFrame, **target) -> DataFrame:
    """The mixed documents with the input's columns, in block order; a document comes as often as its passes take it."""
    block = ["_block_order", "_source", "_block", "_pass"]
    return plan(docs, **target).repartition(*block).sortWithinPartitions(*block, "_doc_order").select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    """One row for each time that a document is taken, with the keys that order the mix."""
    return plan(docs, carried=["doc_id"]).select("doc.doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_pass").alias("pass"), F.col("_block").alias("block"), F.col("_block_order").alias("block_order"), F.col("_doc_order").alias("doc_order"))
