"""Placing again after a change of directories, directories as versions, and decisions with refusals."""

from __future__ import annotations

import pytest

from ledgerloom.operators import reresolve, resolve
from ledgerloom.operators.publication import Store

CLUES = "id long, district_name string, district_source string, location string, pincode string, office string, note string"
ROWS = [
    (1, None, None, None, "400001", None, "x"), (2, None, None, "Kokrajhar", None, None, "x"), (3, None, None, None, "400002", None, "x"), (4, "Purba Nagar", "chain_unit", None, None, None, "x"),
    (5, None, None, "Belsor, Nalbari", None, None, None), (6, None, None, None, None, "Belsor", "x"), (7, None, None, None, None, None, None), (8, None, None, "", "", "", ""), (9, None, None, "Nalbari " * 3000, "400001", None, "x"),
]


def directories(spark, districts, pincodes, offices, aliases):
    frame = spark.createDataFrame
    return reresolve.Directories(frame(districts, "id long, name_en string"), frame(pincodes, "pincode string, district_id long"), frame(offices, "office string, district_id long"), frame(aliases, "key string, district_id long, alias string"))


@pytest.fixture(scope="module")
def versions(spark):
    old = directories(spark, [(10, "Nalbari")], [("400001", 10), ("400001", 11), ("400002", 10), ("400003", 10)], [("Belsor", 10), ("Belsor", 11)], [])
    new = directories(spark, [(10, "Nalbari"), (11, "Kokrajhar")], [("400001", 11), ("400001", 11), ("400002", 11), ("400003", 10)], [("Belsor", 11)], [("prbngr", 11, "Purba Nagar")])
    return old, new


def test_changed_keys_are_those_whose_answer_changed(versions):
    got = {(r.kind, r.key) for r in reresolve.changed_keys(*versions).collect()}
    assert got == {("name", "kkrjhr"), ("alias", "prbngr"), ("pincode", "400001"), ("pincode", "400002"), ("office", "Belsor")}


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_that_meet_a_change_run_again_as_in_a_full_run(spark, versions, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(reresolve, "BROADCAST_KEYS", 1)
    old, new = versions
    clues = spark.createDataFrame(ROWS, CLUES)
    held = resolve.resolve(clues, old.districts, old.pincodes, old.offices, old.aliases)
    decided = spark.createDataFrame([(6,), (6,), (None,)], "id long")
    got = {r.id: (r.district_id, r.method, r.outcome) for r in reresolve.reresolved(held, clues, decided, old, new).collect()}
    assert got == {
        1: (11, "pincode", "placed"), 2: (11, "location_district", "placed"), 3: (10, "pincode", "held"), 4: (11, "chain_unit", "placed"), 5: (10, "location_district", "held"),
        6: (None, None, "decided"), 7: (None, None, "unmet"), 8: (None, None, "unmet"), 9: (11, "pincode", "placed"),
    }
    full = {r.id: r.district_id for r in resolve.resolve(clues, new.districts, new.pincodes, new.offices, new.aliases).collect()}
    assert all(got[i][0] == full[i] for i in got if got[i][2] in ("placed", "unplaced", "unmet"))
    none = reresolve.reresolved(held.limit(0), clues.limit(0), decided, old, new)
    assert none.count() == 0


def test_nothing_changed_runs_nothing_again(spark, versions):
    old, _ = versions
    clues = spark.createDataFrame(ROWS, CLUES)
    assert reresolve.affected(clues, reresolve.changed_keys(old, old)).count() == 0


def test_a_directory_is_replaced_whole_and_other_tables_stay(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    load = lambda *rows: spark.createDataFrame(list(rows), "pincode string, office string")
    path, _ = store.write(load(("1", "kept")))
    store.publish(1, {"document": [path]})
    assert reresolve.replaced(store, load(("1", "a"), ("1", "a"), ("2", "b"))) == 2
    assert reresolve.replaced(store, load(("3", "c"))) == 1
    assert [tuple(r) for r in store.table("directory").collect()] == [("3", "c")] and store.table("document").count() == 1
    assert store.version()[0] == 3


def test_decisions_place_in_order_or_are_refused(spark):
    units = spark.createDataFrame([(1, "state", "27", "S", None), (2, "state", "28", "T", None), (10, "district", "5", "Nalbari", 1), (11, "district", "6", "Other", 2)], "id long, level string, lgd_code string, name_en string, parent_id long")
    tenders = spark.createDataFrame([(100, "p", "a", None), (101, "p", "b", 10), (102, "q", "c", None)], "id long, portal_code string, portal_tender_id string, admin_unit_id long")
    portals = spark.createDataFrame([("p", "27"), ("q", None)], "portal_code string, state_lgd_code string")
    rows = [
        (1, "p", "a", None, "R", "no place"), (2, "p", "a", "5", "R", "read"), (3, "p", "a", None, "R", "late"), (4, "p", "a", "6", "R", "other state"), (5, "p", "a", "5", " ", "x"), (6, "p", "b", None, "R", "x"),
        (7, "q", "c", "5", "R", "x"), (8, "p", "zz", "5", "R", "x"), (9, None, None, None, None, None), (10, "p", "a", "5", "R", "again"), (11, "p", "b", "5", "R", "x"),
    ]
    decisions = spark.createDataFrame(rows, "decision_id long, portal_code string, portal_tender_id string, lgd_code string, decided_by string, reason string")
    got = {r.decision_id: r for r in reresolve.placed_by_hand(decisions, tenders, portals, units).collect()}
    placed = {i: (r.admin_unit_id, r.evidence, r["last"]) for i, r in got.items() if r.admin_unit_id}
    assert placed == {2: (10, "decision:2", False), 10: (10, "decision:10", True), 11: (10, "decision:11", True)}
    already, foreign = "already placed; decide a district, or leave it", "not a district of the tender's state"
    assert {i: r.refused for i, r in got.items()} == {
        1: None, 2: None, 3: already, 4: foreign, 5: "a decision needs the reviewer's name and a reason", 6: already, 7: "the portal has no state", 8: "no such tender on the portal",
        9: "a decision needs the reviewer's name and a reason", 10: None, 11: None,
    }
