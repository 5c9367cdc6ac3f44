"""The ten operators against brute force on small fixtures, with the cases that each docstring defines."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, classifier, components, html_extract, line_dedup, minhash, mixing, pii, quality_rules, substring
from ledgerloom.llm.text import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeated lines, nulls and empty texts."""
    draw = random.Random(seed)
    vocab = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(draw.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(draw.choice(vocab) for _ in range(k))
    passage, line = text(40), text(25)
    texts: list[str | None] = [None, "", " \n\t ", "one", "Two words", text(3000)]
    while len(texts) < n:
        kind = draw.randrange(6)
        base = f"{text(draw.randint(5, 120))}\n{text(30)}\n{text(12)}"
        if kind == 1:
            base = f"{text(10)} {passage} {text(10)}"
        elif kind == 2 and texts[-1]:
            base = texts[draw.randrange(5, len(texts))]
        elif kind == 3 and texts[-1]:
            words = texts[draw.randrange(5, len(texts))].split(" ")
            words[draw.randrange(len(words))] = "changed"
            base = " ".join(words)
        elif kind == 4:
            base = f"{line}\n{text(20)}\n{line[:-1]}x\n\n{line}"
        texts.append(base)
    return [(i * 3, t, ["en", "fr", None][i % 3], f"s{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, ids shared by different texts, and columns whose names the operators use inside."""
    rows = [(1, "a b c d e f g h i j k l m n o", "en", "x", 1), (1, "a b c d e f g h i j k l m n o", "en", "x", 1), (None, "a b c d e f g h i j k l m n o", None, None, None), (None, None, None, None, None), (2, "other text\nother text", "en", "x", 1), (2, "a b c d e f g h i j k l m n o", "en", "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "removed", "_lines", "_id", "words", "n_words", "kept", "classes", "chunk", "_tokens", "_source", "doc", "verdict"):
        frame = frame.withColumn(name, F.lit("mine"))
    return frame


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def test_word_hashes_agree_with_words():
    texts = [t or "" for _, t, *_ in corpus()] + ["x" * 3_000_000, "ab " * 900_000]
    hashes, offsets = word_hashes([t.encode() for t in texts])
    by_word: dict[str, int] = {}
    at = 0
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        words = words_of(text)
        assert b - a == len(words)
        for w in words:
            assert by_word.setdefault(w, int(hashes[at])) == int(hashes[at])
            at += 1
    assert len(set(by_word.values())) == len(by_word)


def test_quality_base_columns(docs):
    for row in quality_rules.judge(docs, "doc_id", "text").collect():
        w = words_of(row.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in (row.text or "").split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), dup, len(covered))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", row.text or ""))
        assert row.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (row.base_failed and row.kept)


def test_quality_rejects_what_is_unlike_its_language(spark):
    draw = random.Random(3)
    common = ["the", "of", "and", "to", "in", "is"]
    clean = lambda: " ".join(draw.choice(common) if draw.random() < 0.4 else "".join(draw.choice("etaoinshr") for _ in range(6)) for _ in range(150))
    rows = [(i, clean(), "en", "s", 0) for i in range(80)] + [(100, re.sub(" ", "%%% ", clean()), "en", "s", 0), (101, clean().upper(), "en", "s", 0)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA), "doc_id").collect()}
    assert not got[100] and not got[101] and all(got[i] for i in range(80))
    assert quality_rules.jensen_shannon(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1) and quality_rules.jensen_shannon(np.ones(3), np.ones(3)) == pytest.approx(0)


def test_quality_references_leave_out_what_fails_the_base_rules(spark):
    """A third of the language's words are repeated windows of junk; the clean documents stay."""
    draw = random.Random(5)
    common = ["the", "of", "and", "to", "in", "is"]
    clean = lambda: " ".join(draw.choice(common) if draw.random() < 0.4 else "".join(draw.choice("etaoinshr") for _ in range(6)) for _ in range(600))
    junk = " ".join(["buy cheap pills online now best price today"] * 75)
    rows = [(i, clean(), "en", "s", 0) for i in range(60)] + [(100 + i, junk, "en", "hot", 0) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge(frame, "doc_id").collect()}
    assert all(got[100 + i].base_failed for i in range(30)) and all(got[i].kept for i in range(60))
    reference = quality_rules.references(frame).first()
    assert reference.n_words == 60 * 600 and not {"buy", "pills"} & {e.name for e in reference.words}


def test_quality_common_words_do_not_depend_on_grouping(docs, monkeypatch):
    shape = lambda rows: sorted((r.lang, tuple(map(tuple, r.classes)), tuple(map(tuple, r.words)), r.n_words) for r in rows)
    one = shape(quality_rules.references(docs.coalesce(1)).collect())
    assert one == shape(quality_rules.references(docs.repartition(7)).collect())


def brute_substring(rows: list[tuple], width: int = 13) -> dict:
    first: dict[tuple, int] = {}
    for i, text, *_ in sorted(rows):
        w = words_of(text)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, text, *_ in rows:
        w = words_of(text)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 900])
def test_substring_dedup(docs, monkeypatch, chunk_bytes):
    monkeypatch.setattr(substring, "CHUNK_BYTES", (chunk_bytes, 256 << 20))
    monkeypatch.setattr(substring, "_ROOT_FACTOR", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs).collect()}
    assert got == brute_substring(corpus())
    for r in substring.remove_repeats(docs).collect():
        assert r.n_removed == sum(s.end - s.start for s in r.intervals)
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False))


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(5)
    texts = [t or "" for _, t, *_ in corpus()] + ["<|endoftext|> a<|startoftext|>b <|endoftext", "İ ΑΣ é \x1c x\x1dy  日本 😀😀 1234 !!?", "don't DON'T 's 'S'LL x's1's"]
    texts += ["".join(chr(draw.choice([draw.randrange(0, 0x2FFF), draw.randrange(30, 123)])) for _ in range(200)) for _ in range(100)] + ["".join(draw.choice("ab") for _ in range(25)) for _ in range(200)]
    coder = bpe.TrieBpe(bpe.vocabulary(path))
    packed = coder.encode(texts)
    for text, got, want in zip(texts, packed, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
        assert coder.decode([got])[0] == library.decode(want.ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, t, *_ in corpus():
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.encode(docs, path).join(bpe.decode(bpe.encode(docs, path), path), "doc_id").collect()
    assert len(both) == len(corpus())


def test_classifier_on_held_out_rows(spark):
    draw = random.Random(9)
    clean = lambda: " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(80))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = clean()
        if bad:
            cut = draw.randrange(len(text) // 2)
            text = text[:cut] + re.sub(" ", "$$$ ", text[cut:])
        rows.append((i, text, "en", "s", 0))
        labels.append((i, int(not bad), 0))
    frame = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", "en", "s", 0)], SCHEMA)
    got = {r.doc_id: r for r in classifier.report(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in held]) > 0.9
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    unlabelled = classifier.report(frame, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_classifier_chunks_cover_everything():
    for n in (0, 1, classifier.CHUNK - 1, classifier.CHUNK, classifier.CHUNK + 1, 5000):
        data = bytes(1 + i % 250 for i in range(n))
        chunks = classifier.cut(data)
        step = classifier.CHUNK - classifier.OVERLAP
        joined = b"".join(c[:step].tobytes() for c in chunks[:-1]) + chunks[-1].tobytes()
        assert joined[:n] == data and not any(joined[n:])


def test_html_main_text(spark):
    article = "<p>First, a paragraph of some length, with commas &amp; words.<p>Second   one,\n also quite long, so it counts.<ul><li>item one<li>item two</ul><p>Short.</p>"
    page = f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div id='sidebar'>Links, many, of, them, all of it long enough to be read</div><article><h1>Title</h1>{article}<form>q</form><aside>x</aside></article><div class='comments'><p>A reader, who says, a lot, about, this, and more.</p></div><div class='cookie-notice'>We use cookies, and more, than you like.</div><footer>&copy; me</footer></body></html>"
    want = "Title\nFirst, a paragraph of some length, with commas & words.\nSecond one, also quite long, so it counts.\nitem one\nitem two\nShort."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (5, "u", "<p>a<b>b"), (6, "u", "<" * 5000), (7, "u", "<div>" * 3000 + "deep, text"), (None, "u", page)]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("mine"))).collect()}
    assert got[1].text == want == got[None].text
    assert (got[2].text, got[3].text, got[4].text, got[5].text, got[7].text) == ("", "", "plain text", "ab", "deep, text")
    assert all(r.n_chars == len(r.text) for r in got.values())
    div = "<body><div class='menu'><a href='x'>a, b, c, d</a></div><div class='post'><p>Some text, that is long enough, to be an article.</p><p>And, more, of it, which goes on for a while.</p></div><div class='related'><p>Other, things, to read, which are not part.</p></div></body>"
    assert html_extract.extract(div).startswith("Some text") and "Other" not in html_extract.extract(div) and "And, more" in html_extract.extract(div)


def brute_sets(rows: list[tuple], size: int) -> dict:
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = {}
    for i, t, *_ in rows:
        w = words_of(lower(t))
        n = min(size, len(w))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    return out


def brute_components(sets: dict, percent: int = 80) -> dict:
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_components(spark, size):
    rows = corpus(seed=size, n=150)
    sets = brute_sets(rows, size)
    want = brute_components(sets)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = minhash.keep_first(spark.createDataFrame(rows, SCHEMA), size)
    assert kept.columns == SCHEMA_COLUMNS and {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}


def test_minhash_in_a_crowd_below_the_threshold(spark):
    """Documents alike at 0.77 with one changing passage hide no pair alike at 0.81."""
    draw = random.Random(12)
    some = lambda k: [" " + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(k)]
    stem = some(86)
    texts = [stem + some(13) for _ in range(800)]
    for _ in range(100):
        start = some(3)
        texts += [stem + start + some(10), stem + start + some(10)]
    rows = [(i, "".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert {i: c for i, c in got.items() if i != c} == {801 + 2 * i: 800 + 2 * i for i in range(100)}


SCHEMA_COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def test_components_of_chains_stars_and_ties(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)] + [(1299, 1000), (1005, 1005)]
    links = chain + star + [(5000, 5001), (5001, 5000), (5000, 5001), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 5000: 5000, 5001: 5000}


def test_pii_spans(spark):
    text = "Mail a.b+c@mail.example.com or @x or a@b; ip 10.0.0.255 and 1.2.3.456 and 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111 or 4111 1111 1111 1112, call +1 (389) 555-5010 or +12 34, bank IBAN DE89 3704 0044 0532 0130 00 not DE89 3704 0044 0532 0130 01; ssn: 078-05-1120"
    spans = pii.find(text)
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in spans]
    assert found == [("email", "a.b+c@mail.example.com"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (389) 555-5010"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "078-05-1120")]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(2)
    for _ in range(3000):
        t = "".join(draw.choice("a1.@-+ %é") for _ in range(30))
        base = [(m.start(), m.end()) for m in email.finditer(t)]
        assert [(s["start"], s["end"]) for s in pii.find(t) if s["kind"] == "email"] == base
        base = [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [(s["start"], s["end"]) for s in pii.find(t) if s["kind"] == "ip"] == base
    assert pii.find("9" * 200_000) == [] and pii.find("a" * 200_000 + "@") == []
    got = pii.find_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), redacted=True).orderBy("doc_id").collect()
    assert got[0].redacted.startswith("Mail [email] or @x") and got[1].spans == [] and got[1].redacted == ""
    row = pii.report(spark.createDataFrame([(1, "é a@b.c")], "doc_id bigint, text string")).first()
    assert (row.n_email, row.spans, row.base_sha256) == (1, "email:2:7", hashlib.sha256(b"email:2:7").hexdigest())


def brute_lines(rows: list[tuple]) -> dict:
    k = line_dedup.SHINGLE
    first: dict[str, tuple] = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate(t.split("\n") if t is not None else []):
            if WORD.search(line):
                first.setdefault(line, (i, n))
    sets = {first[line]: {line[j : j + k] for j in range(max(1, len(line) - k + 1))} for line in first}
    root = brute_components(sets)
    gone = {}
    for i, t, *_ in rows:
        gone[i] = [n for n, line in enumerate(t.split("\n") if t is not None else []) if WORD.search(line) and root[first[line]] != (i, n)]
    return gone


def test_fuzzy_lines(spark):
    rows = corpus(seed=11, n=90)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute_lines(rows)
    assert sum(map(len, want.values())) > 20
    got = {r.id: sorted(r.removed) for r in line_dedup.removed_lines(frame).collect()}
    assert got == {i: n for i, n in want.items() if n}
    done = {r.doc_id: r for r in line_dedup.deduplicate(frame).collect()}
    for i, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        assert done[i].text == (None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in want[i]))
        assert (done[i].n_lines, done[i].n_removed) == (len(lines), len(want[i]))
    plan = line_dedup.report(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def found_pairs(spark, lines: list[tuple[str, str]], others: list[str] = ()) -> int:
    """How many of the pairs lose their second line; the other lines all stay."""
    text = "\n".join([*others, *(x for pair in lines for x in pair)])
    got = line_dedup.removed_lines(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).first()
    removed = set(got.removed) if got else set()
    assert removed <= {len(others) + 2 * i + 1 for i in range(len(lines))}
    return len(removed)


def test_short_fuzzy_lines_at_the_threshold(spark):
    """Eight common shingles and one of its own in each line: a similarity of exactly 0.8."""
    draw = random.Random(6)
    some = lambda k: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    stems = [some(line_dedup.SHINGLE + 7) for _ in range(4000)]
    assert found_pairs(spark, [(s + "1", s + "2") for s in stems]) >= 3960


def test_fuzzy_lines_with_one_changed_character(spark):
    """The width of shingles is five characters: an inner edit keeps lines of 49 characters, not of 48, at 0.8."""
    assert line_dedup.SHINGLE == 5
    draw = random.Random(8)
    some = lambda k: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    edited = lambda x: (x, f"{x[:20]}7{x[21:]}")
    assert found_pairs(spark, [edited(some(55)) for _ in range(300)]) >= 297
    assert found_pairs(spark, [edited(some(49)) for _ in range(300)]) >= 294
    assert found_pairs(spark, [edited(some(48)) for _ in range(300)]) == 0


@pytest.mark.parametrize("crowd", [300, 1500])
def test_fuzzy_lines_in_a_crowd_below_the_threshold(spark, crowd):
    """Template lines alike at 0.74 with one changing field hide no pair alike at 0.81."""
    draw = random.Random(crowd)
    some = lambda k: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    stem = some(77)
    starts = ["".join(t) for t in draw.sample(list(itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4)), crowd + 100)]
    pairs = [(f"{stem}{t}{some(9)}", f"{stem}{t}{some(9)}") for t in starts[crowd:]]
    assert found_pairs(spark, pairs, [stem + t + some(9) for t in starts[:crowd]]) >= 98


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(1500, 32))
    v[700:900] = v[0]
    rows: list[tuple] = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, [float("nan")] + [1.0] * 31, 0), (5003, [None] + [1.0] * 31, 0), (5100, [1.0, 2.0], 0), (5200, [2.0, 2.0], 0), (None, [1.0] * 32, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    got: dict[int, list] = {}
    for r in ann.report(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {*range(0, 1500, 100), 5100, 5200} and [x for x, _ in got[5100]] == [5200]
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10].tolist()
        hits += len({x for x, _ in got[q]} & set(want))
        assert all(s == pytest.approx(d[x]) for x, s in got[q])
    assert hits == 150 and [x for x, _ in got[0]] == list(range(700, 710))


def test_one_bit_bounds_hold():
    draw = np.random.default_rng(7)
    v, q = draw.normal(size=(2000, 64)), draw.normal(size=(20, 64))
    centre, turn = v.mean(axis=0), ann.rotation(64)
    low, high = ann.bounds(*ann.encode(v, centre, turn), q, centre, turn)
    true = ((v[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.99


def test_mixing(spark):
    tokens = {"big": 100_000, "mid": 10_000, "small": 500}
    exponent, weights = mixing.solve(tokens, 0.9, None)
    assert 0 < exponent < 1 and mixing.entropy(weights) == pytest.approx(0.9 * np.log(3), abs=1e-6)
    exponent, weights = mixing.solve(tokens, 1.0, 2.0)
    assert max(w * 110_500 / tokens[s] for s, w in weights.items()) == pytest.approx(2, abs=1e-6)
    assert mixing.solve({"a": 5}, 0.9, 4.0)[0] == 1.0 and mixing.solve({}, 0.9, 4.0)[1] == {}
    rows = [(i, "w " * (20 + i % 5), None, "big" if i % 10 else "small", 0) for i in range(400)] + [(900, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(frame, 1.0, 3.0).select("doc.doc_id", "_source", "_tokens", "_pass").collect()
    total = mixing.source_tokens(frame)
    _, weights = mixing.solve(total, 1.0, 3.0)
    for s in ("big", "small"):
        taken = sum(r["_tokens"] for r in got if r["_source"] == s)
        assert 0 <= taken - weights[s] * sum(total.values()) < 50
    by_pass = Counter((r["_source"], r["_pass"], r["doc_id"]) for r in got)
    assert set(by_pass.values()) == {1}
    full = Counter((r["_source"], r["_pass"]) for r in got)
    assert full["small", 1] == 40 and sum(r["doc_id"] == 900 for r in got) == 1
    assert mixing.mix(frame).columns == SCHEMA_COLUMNS


def test_empty_tables_and_odd_rows(none, odd):
    """No operator fails on empty tables, null ids, repeated rows or clashing columns; each keeps its rows."""
    path = public_tokenizers.path("word_bpe_49k.json")
    per_row = {
        "quality": lambda d: quality_rules.judge(d, "doc_id"), "substring": substring.report, "bpe": lambda d: bpe.digests(d, path), "pii": pii.report,
        "minhash": lambda d: minhash.near_duplicates(d, 2), "lines": line_dedup.rewrite, "cnn": lambda d: classifier.report(d, d.select("doc_id", F.lit(1).alias("quality"))),
        "html": lambda d: html_extract.main_text(d, "doc_id", "lang", "text"),
    }
    for name, f in per_row.items():
        assert f(none).count() == 0, name
        assert f(odd).count() == 6, name
    for f in (quality_rules.keep, line_dedup.rewrite, minhash.keep_first, mixing.mix):
        assert f(none).columns == none.columns and f(odd).columns == odd.columns
        assert f(none).count() == 0
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring.report(odd).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, 0), (2, 15)]
    alike = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(odd, 2).collect()}
    assert (2, 1) in alike and (1, 1) in alike and (None, None) in alike
    assert {r.doc_id for r in mixing.mix(odd).collect()} == {1, 2, None}
