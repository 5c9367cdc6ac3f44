"""Operator 5: BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are normalised and cut into pieces by the vocabulary file's own
rules; the distinct pieces, in sorted order, are the depth-first walk of a trie. At each trie node
only the last token of the node's prefix is worked out, from the last tokens of its ancestors, so a
prefix that many pieces share is encoded once. A piece's ids are read back along its path.

Why one token a node is enough: a token sequence is the BPE encoding of its text if and only if each
pair of neighbours is (merges never cross the border of such a pair), so the encoding of a prefix is
the encoding of a shorter ancestor prefix and one token that may follow that ancestor's last token.

Defined cases: a null text is the empty text and has no tokens; empty tables give empty tables;
repeated rows and ids give a row each; other columns of the input are kept out of the result.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import bounded_batches

#: Words, and pieces, whose ids a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Characters of text that are encoded against one trie.
TRIE_CHARS = 4_000_000
#: The characters with Unicode's White_Space property.
_SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
#: Characters at which str.split() cuts although they lack that property.
_NOT_SPACES = re.compile("[\x1c-\x1f]")
#: The vocabulary's own pattern, for words of lower-case ASCII; other words go through the library's splitter.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
_PLAIN = re.compile("[!-~]+").fullmatch


class TrieBpe:
    """Encoder and decoder for a vocabulary file of the BPE kind with a word-end suffix."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        library = Tokenizer.from_str(spec)
        self._normalize, self._pieces_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self._special = special
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = np.empty(1 + max([*self.vocab.values(), *special.values()]), object)
        for table in (self.vocab, special):
            for s, i in table.items():
                self.strings[i] = s
        vocab, end = self.vocab, self.suffix
        # rank of the merge that makes a token, and its two halves; letters have rank -1
        self._rank, self._halves, self._merge = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self._merge[vocab[a], vocab[b]] = r
            self._rank.setdefault(i, r)
            self._halves.setdefault(i, (vocab[a], vocab[b]))
        self._inside = {s: i for s, i in vocab.items() if not (end and s.endswith(end))}
        self._final = {s[: len(s) - len(end)]: i for s, i in vocab.items() if s.endswith(end)}
        self._longest = max(map(len, self._inside))
        self._longest_final = max(map(len, self._final))
        self._follows: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._piece_ids: dict[str, bytes] = {}
        split = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._ascii = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two tokens alone.

        Undo the two tokens' own merges from the latest to the earliest. At every stage a pair of parts
        touches at the border; it would have merged if its rank comes before the merge that takes up
        either part (on equal ranks the leftmost goes first: the left token's own merge, then the border).
        """
        key = left << 20 | right
        known = self._follows.get(key)
        if known is not None:
            return known
        rank, halves, x, y = self._rank, self._halves, left, right
        until_x = until_y = 1 << 30
        while True:
            m = self._merge.get((x, y))
            if m is not None and m < until_x and m <= until_y:
                ok = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                ok = True
                break
            if rx > ry:
                until_x, x = rx, halves[x][1]
            else:
                until_y, y = ry, halves[y][0]
        self._follows[key] = ok
        return ok

    def _last_token(self, piece: str, depth: int, path: list[int], table: dict[str, int], longest: int) -> tuple[int, int]:
        """The one token that ends piece[:depth] in its encoding, and its length. path[d]: last token of piece[:d]."""
        get = table.get
        for start in range(max(0, depth - longest), depth):
            t = get(piece[start:depth])
            if t is not None and (not start or self._may_follow(path[start], t)):
                return t, depth - start
        raise ValueError(f"no token ends {piece[:depth]!r}")

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces: one depth-first walk over their trie, whose paths the sorted order gives."""
        out, path, widths, before = {}, [-1], [0], ""
        for piece in sorted(pieces):
            shared, most = 0, min(len(before), len(piece), len(path) - 1)
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del path[shared + 1 :], widths[shared + 1 :]
            last = len(piece) - 1 if self.suffix else len(piece)
            for d in range(len(path), last + 1):
                t, n = self._last_token(piece, d, path, self._inside, self._longest)
                path.append(t)
                widths.append(n)
            ids, d = [], len(piece)
            if self.suffix:
                t, n = self._last_token(piece, d, path, self._final, self._longest_final)
                ids.append(t)
                d -= n
            while d:
                ids.append(path[d])
                d -= widths[d]
            out[piece] = struct.pack(f"<{len(ids)}I", *reversed(ids))
            before = piece
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self._words) > REMEMBERED:
            self._words.clear()
        if len(self._piece_ids) > REMEMBERED:
            self._piece_ids.clear()
        new = list(words - self._words.keys())
        # no rule of the normaliser reaches across a space, so all words are normalised in one call
        clean = self._normalize(" ".join(new)).split(" ") if new else []
        if len(clean) != len(new):
            clean = [self._normalize(w) for w in new]
        cut = [_ASCII_PIECES(w) if self._ascii and _PLAIN(w) else [p for p, _ in self._pieces_of(w)] for w in clean]
        known = self._piece_ids
        known.update(self.encode_pieces({p for ps in cut for p in ps} - known.keys()))
        for w, ps in zip(new, cut, strict=True):
            self._words[w] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        parts = []
        for text in texts:
            segments = self._special_re.split(text) if self._special and "<" in text else [text]
            parts.append([s if i % 2 else (_SPACES.split(s) if _NOT_SPACES.search(s) else s.split()) for i, s in enumerate(segments)])
        words = {w for segments in parts for s in segments if isinstance(s, list) for w in s if w}
        self._learn(words)
        known = self._words
        out = []
        for segments in parts:
            got = []
            for s in segments:
                if isinstance(s, str):
                    got.append(np.array([self._special[s]], "<u4").tobytes())
                else:
                    got.extend([known[w] for w in s if w])
            out.append(b"".join(got))
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        """The tokens' strings joined by one space: what a file without a decoder section decodes to."""
        return [" ".join(self.strings[np.frombuffer(b, "<u4")].tolist()) for b in packed]


_coders: dict[int, TrieBpe] = {}


def _coder(spec: str) -> TrieBpe:
    if (key := hash(spec)) not in _coders:
        _coders[key] = TrieBpe(spec)
    return _coders[key]


def _groups(texts: list, most: int) -> Iterator[list]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def vocabulary(path: str) -> str:
    """A vocabulary file's text. It is read once, where the job is planned, and has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row a document: id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, the decoded text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + (", decoded string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for group in _groups(texts, TRIE_CHARS):
                ids = coder.encode(group)
                columns = [batch.column(0).slice(at, len(group)), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(coder.decode(ids), pa.string()))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of packed ids: id and the decoded text; null ids decode to the empty text."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            texts = coder.decode([b or b"" for b in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens and SHA-256 of the ids and of the decoded text."""
    return encode(docs, path, decode=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
