"""Cases that gave wrong or incomplete answers once: deep trees, long names, far characters, full word lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import facts, markup
from ledgerloom.operators import gazetteer, hierarchy, reconcile
from ledgerloom.sources import files


def test_entities_beyond_the_first_plane(spark):
    rows = [("&#128512;&#x1F600;&amp;", "😀😀&"), ("&#99999;", "\U0001869f"), ("&#55296; &#0; &#1114112;", "&#55296; &#0; &#1114112;"), ("a&#233;&#xE9;", "aéé"), ("none", "none")]
    frame = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in frame.select(markup.decode_entities(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_a_deep_tree_reaches_its_root(spark):
    chain = [(i, i - 1 if i > 1 else None, "level", f"u{i}") for i in range(1, 8)]
    units = spark.createDataFrame(chain, "id int, parent_id int, level string, name_en string")
    got = {(r.ancestor_id, r.descendant_id, r.depth) for r in hierarchy.closure(units).collect()}
    assert got == {(a, d, d - a) for d in range(1, 8) for a in range(1, d + 1)}
    assert [r.id for r in hierarchy.ancestors(units, 7).orderBy("depth").collect()] == [7, 6, 5, 4, 3, 2, 1]
    assert {r.id for r in hierarchy.within(units, units.where("id = 3")).collect()} == {3, 4, 5, 6, 7}
    assert {r.depth for r in hierarchy.closure(units, 2).collect()} == {0, 1, 2}


def test_long_names_and_equal_times(spark):
    pages = spark.createDataFrame([(1, "Roads of Dadra and Nagar Haveli and Daman are long. Nagar is near.")], "id int, text string")
    names = spark.createDataFrame([("Dadra and Nagar Haveli and Daman", "district"), ("Nagar", "district")], "name string, level string")
    assert {r.value for r in gazetteer.places_in(pages, names).collect()} == {"Dadra and Nagar Haveli and Daman district", "Nagar district"}
    same = spark.createDataFrame([("k", 5, v) for v in (3, 1, 2)], "key string, at int, value int")
    assert [r.value for r in reconcile.versions(same, ["key"], "at", ["value"]).orderBy("value").collect()] == [1, 2]


def test_department_words_in_full(spark):
    rows = [("The Maharashtra Finance Department said", "Finance Department"), ("Joint Public Works Department", "Public Works Department"), ("the concerned Nodal Department", None)]
    frame = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in frame.select(F.array_join(facts.bodies(F.col("t")), ";").alias("got")).collect()] == [w or "" for _, w in rows]


def test_too_many_counters_are_refused(spark):
    assert files.metrics_text(spark.createDataFrame([("b", 2), ("a", 1)], "name string, value int")) == "a 1\nb 2\n"
    with pytest.raises(ValueError):
        files.metrics_text(spark.range(10_001).selectExpr("concat('c', id) AS name", "id AS value"))
