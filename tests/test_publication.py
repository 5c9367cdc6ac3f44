"""Promotion: parity, versions that appear whole or not at all, ids, refusals, refreshes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import publication, reviews


@pytest.fixture
def store(spark, tmp_path):
    return publication.Store(spark, str(tmp_path / "store"))


def source(spark, documents=((7, "a", "district", "1"), (9, "b", None, None)), facts=((30, 7, None, "verified"), (20, 7, 30, "unverified"), (5, 9, 20, "corrected"), (6, 9, 99, "rejected"))):
    return {
        "document": spark.createDataFrame(list(documents), "id bigint, sha256 string, level string, lgd_code string"),
        "page": spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 9, 1), (4, 55, 1)], "id bigint, document_id bigint, page_number int"),
        "fact": spark.createDataFrame(list(facts), "id bigint, document_id bigint, same_figure_as bigint, verification_status string"),
        "history": spark.createDataFrame([(1, 30, "x"), (2, 77, "y")], "id bigint, fact_id bigint, reviewer string"),
    }


def units(spark):
    return spark.createDataFrame([(500, "district", "1")], "id bigint, level string, lgd_code string")


def test_promotion_maps_ids_and_drops_foreign_links(spark, store):
    done = publication.promote(store, source(spark), units(spark))
    assert done == {"document": 2, "page": 3, "fact": 4, "history": 1, "published": 2, "version": 1}
    assert sorted(tuple(r) for r in store.table("document").select("id", "sha256", "admin_unit_id").collect()) == [(1, "a", 500), (2, "b", None)]
    facts = {r["id"]: (r["document_id"], r["same_figure_as"], r["link_dropped"]) for r in store.table("fact").collect()}
    assert facts == {1: (2, 3, False), 2: (2, None, True), 3: (1, 4, False), 4: (1, None, False)}
    assert store.table("history").select("fact_id").first()[0] == 4
    assert publication.promote(store, source(spark), units(spark))["version"] == 1  # nothing new, no new version
    more = source(spark, documents=((7, "a", "district", "1"), (9, "b", None, None), (11, "c", None, None)), facts=((40, 11, None, "verified"),))
    assert publication.promote(store, more, units(spark))["version"] == 2
    assert store.table("document").agg(F.max("id")).first()[0] == 3 and store.table("fact").agg(F.max("id")).first()[0] == 5


def test_failed_parity_leaves_readers_on_the_old_version(spark, store):
    publication.promote(store, source(spark, documents=((7, "a", "district", "1"),)), units(spark))
    before = sorted(tuple(r) for r in store.table("fact").collect())
    for name in ("document", "page", "fact", "published", "history"):
        wrong = {"document": 1, "page": 1, "fact": 2, "published": 1, "history": 0}
        wrong[name] += 1
        with pytest.raises(publication.PromotionRefused, match=name):
            publication.promote(store, source(spark), units(spark), wrong)
        assert store.version()[0] == 1 and sorted(tuple(r) for r in store.table("fact").collect()) == before
    assert publication.promote(store, source(spark), units(spark))["version"] == 2


def test_a_page_that_cannot_be_placed_fails_parity(spark, store):
    """Facts that share an id multiply a join on it: counted, and refused."""
    twice = source(spark, facts=((30, 7, None, "verified"), (30, 7, None, "verified")))
    with pytest.raises(publication.PromotionRefused, match="fact"):
        publication.promote(store, twice, units(spark))
    assert store.version() == (0, {})


def test_unknown_places_refuse_before_anything_is_published(spark, store):
    with pytest.raises(publication.PromotionRefused, match="district 2"):
        publication.promote(store, source(spark, documents=((7, "a", "district", "2"),)), units(spark))
    assert store.version() == (0, {}) and store.table("fact") is None


def test_a_version_is_written_once(spark, store):
    publication.promote(store, source(spark), units(spark))
    with pytest.raises(Exception, match="(?i)exists"):
        store.publish(1, {"fact": ["elsewhere"]})


def test_reserved_ids_over_sparse_keys(spark):
    keys = [-(10**17), -5, 0, 1, 99_999, 100_000, 10**10, 10**10 + 1, 10**15, 3 * 10**15, 9 * 10**18, -(9 * 10**18)]
    got = dict(reviews.reserved(spark.createDataFrame([(k,) for k in keys], "id bigint"), "id", 100).collect())
    assert got == {k: 100 + i for i, k in enumerate(sorted(keys))}


VALUES = ["value", "verification_status"]
FACTS = "id bigint, document_id bigint, page_number int, kind string, raw_text string, value string, verification_status string"


def test_refresh_applies_and_refuses(spark, store):
    held = [(1, 1, 1, "m", "a", "10", "unverified"), (2, 1, 1, "m", "a", "11", "unverified"), (3, 1, 2, "m", "b", "12", "verified"), (4, 1, 2, "m", "c", "13", "unverified"), (5, 2, 1, "m", "z", "14", "unverified")]
    read = [(91, 1, 1, "m", "a", "10", "unverified"), (92, 1, 1, "m", "a", "99", "unverified"), (93, 1, 3, "m", "new", None, "unverified"), (94, 1, 3, "m", "new", "7", "unverified")]
    path, _ = store.write(spark.createDataFrame(held, FACTS))
    store.publish(1, {"fact": [path]})
    with pytest.raises(publication.PromotionRefused):
        publication.refresh(publication.Store(spark, store.root + "-none"), spark.createDataFrame(read, FACTS), VALUES)
    done = publication.refresh(store, spark.createDataFrame(read, FACTS), VALUES)
    assert done == {"kept": 2, "updated": 1, "inserted": 2, "retired": 1, "reviewed": 1, "version": 2}
    rows = {r["id"]: (r["raw_text"], r["value"]) for r in store.table("fact").collect()}
    assert {k: rows[k] for k in (1, 2, 3, 5)} == {1: ("a", "10"), 2: ("a", "99"), 3: ("b", "12"), 5: ("z", "14")} and sorted(rows) == [1, 2, 3, 5, 6, 7]
    again = publication.refresh(store, spark.createDataFrame(read, FACTS), VALUES)
    assert again == {"kept": 5, "reviewed": 1, "version": 3}
