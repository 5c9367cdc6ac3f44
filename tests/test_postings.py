"""Search over postings against brute force on random texts."""

from __future__ import annotations

import random
import re

import pytest

from ledgerloom.operators import postings
from ledgerloom.operators.search import EXCERPT_WORDS, parse_query


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows: list[tuple], term: str, limit: int) -> list[tuple]:
    wanted, banned = parse_query(term)
    words = list(dict.fromkeys(w for p in wanted for w in p))
    out = []
    for key, text in rows:
        t = words_of(text)
        line = f" {' '.join(t)} "
        if key is None or not words or not all(f" {' '.join(p)} " in line for p in wanted) or any(w in t for w in banned):
            continue
        places = {w: [i for i, x in enumerate(t) if x == w] for w in words}
        if len(words) == 1:
            rank = 0.1 * sum(1 / (i + 1) ** 2 for i in range(len(places[words[0]]))) / 1.64493406685
        else:
            rest = 1.0
            for i, a in enumerate(words):
                for b in words[i + 1 :]:
                    for x in places[a]:
                        for y in places[b]:
                            if abs(x - y) <= 100:
                                rest *= 1 - postings.nearness(abs(x - y))
            rank = 1 - rest
        start = max(sorted({x for p in places.values() for x in p}), key=lambda s: (sum(any(s <= x < s + EXCERPT_WORDS for x in p) for p in places.values()), -s))
        out.append((-round(rank, 6), key, " ".join(t[start : start + EXCERPT_WORDS])))
    return [(k, -r, e) for r, k, e in sorted(out)[:limit]]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    vocab = ["water", "supply", "of", "the", "Works", "é", "पानी", "x1", "grant", "fund"]
    texts = ["".join(draw.choice(vocab) + draw.choice([" ", " ", ", ", "\n", "-"]) for _ in range(draw.randint(0, 150))) for _ in range(120)]
    return [*enumerate(texts), (500, None), (501, ""), (502, "water"), (503, "water " * 300)]


@pytest.mark.parametrize("term", ["water", "Water supply", '"water supply"', '"of the works" grant -x1', "grant grant", "nowhere water", "", "-water", "é पानी", '"water water"'])
def test_search_by_brute_force(spark, rows, term):
    pages = spark.createDataFrame(rows, "id bigint, text string")
    index = postings.build(pages, partitions=3)
    got = [(r["id"], r["rank"], " ".join(words_of(r["excerpt"]))) for r in postings.search(index, pages, term, 15).orderBy("rank", "id").collect()]
    assert sorted(got) == sorted(brute(rows, term, 15))
    index.drop()


def test_hidden_pages_leave_room_for_others(spark, rows):
    pages = spark.createDataFrame(rows, "id bigint, text string")
    index = postings.build(pages)
    shown = [r for r in rows if r[0] % 2]
    got = postings.search(index, pages.where("id % 2 = 1"), "water", 10).collect()
    assert sorted((r["id"], r["rank"]) for r in got) == sorted(r[:2] for r in brute(shown, "water", 10))


def test_ranking_reads_postings_alone(spark, rows, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "id bigint, text string").write.parquet(path)
    pages = spark.read.parquet(path)
    plan = postings.hits(postings.build(pages), "water supply")._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,water)" in plan


def test_no_pages(spark):
    pages = spark.createDataFrame([], "id bigint, text string")
    assert postings.search(postings.build(pages), pages, "water", 5).count() == 0
