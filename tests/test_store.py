"""The store's manifests, and what writers may do."""

import pytest

from matchloom.operators import store as W
from matchloom.sources.store import Store, StoreError

EVENT = "source string, match_id string, seq int, minute int, type string, payload string, arrival int"


def test_batches_become_visible_whole(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(StoreError):
        Store.open(spark, folder)
    first = Store.create(spark, folder, {"m": "a int, b string", "e": "x int"})
    assert first.table("m").count() == 0 and Store.create(spark, folder, {"m": "a int"}).manifest.number == 1
    rows = spark.createDataFrame([(1, "q")], "a int, b string")
    second = first.publish({"m": rows, "e": spark.range(3).selectExpr("id as x")})
    assert (first.table("m").count(), second.table("m").count(), Store.open(spark, folder).table("e").count()) == (0, 1, 3)
    with pytest.raises(StoreError, match="another"):
        first.publish({"m": rows})
    assert Store.open(spark, folder).table("m").count() == 1
    third = Store.create(spark, folder, {"m": "c double", "n": "z int"})
    assert third.table("m").collect() == [(1, "q", None)] and third.optional("n", "z int").count() == third.optional("gone", "z int").count() == 0
    assert third.publish({"m": rows}, replace=("m",)).table("m").count() == 1
    with pytest.raises(StoreError, match="no columns"):
        third.publish({"m": rows.withColumnRenamed("b", "bb")})


def test_other_major_versions_are_refused(spark, tmp_path):
    folder = str(tmp_path / "store")
    made = Store.create(spark, folder, {"m": "a int"})
    made.manifest.major, made.manifest.number = 2, 2
    made._commit(made.manifest)
    with pytest.raises(StoreError, match="version 2"):
        Store.open(spark, folder)
    with pytest.raises(StoreError, match="version 2"):
        Store.create(spark, folder, {"m": "a int"})


def test_appends_stand_or_fall_together(spark):
    stored = spark.createDataFrame([("s", "m1", 1, 5, "goal", '{"a": 1, "b": 2}', 0)], EVENT)
    matches = spark.createDataFrame([("m1", "s"), ("m2", "s"), ("m3", "t"), ("m5", "s"), ("m6", "s")], "match_id string, source string")
    batch = [
        ("s", "m1", 1, 5, "goal", '{"b": 2, "a": 1}', 1), ("s", "m1", 2, 6, "goal", None, 2), ("s", "m2", 3, 1, "goal", None, 1), ("s", "m2", 3, 1, "goal", None, 2),
        ("s", "m3", 1, 1, "goal", None, 1), ("s", "m4", 1, 1, "goal", None, 1), ("s", "m5", 1, 1, "x", None, 1), ("s", "m5", 2, 1, "goal", None, 2), ("s", "m6", None, 1, "goal", None, 1),
    ]
    found = W.append_events(stored, spark.createDataFrame(batch, EVENT), matches, "arrival", ("goal",))
    assert sorted((r.match_id, r.arrival, r.drift, r.fault, r.refused) for r in found.collect()) == [
        ("m1", 1, "resend", None, False), ("m1", 2, "new", None, False), ("m2", 1, "new", None, True), ("m2", 2, "duplicate", "not_increasing", True), ("m3", 1, "new", "cross_partition", True),
        ("m4", 1, "new", "unseeded", True), ("m5", 1, "new", "undeclared", True), ("m5", 2, "new", None, True), ("m6", 1, "malformed", "malformed", True),
    ]
    twice = spark.createDataFrame([("s", "m1", 1, 5, "goal", '{"a": 1, "b": 2}', 1), ("s", "m1", 1, 9, "goal", '{"a": 1, "b": 2}', 2), ("s", "m1", 0, 9, "goal", None, 3)], EVENT)
    assert {r.arrival: r.drift for r in W.append_events(stored, twice, matches, "arrival").collect()} == {1: "resend", 2: "conflict", 3: "retroactive"}


def test_entities(spark):
    rows = spark.createDataFrame([("s", "1", "team", "Perú", None, 1), ("s", "1", "team", "Peru FC", "peru fc", 2), ("s", "2", "team", "Ä", "b", 1), ("s", "3", None, "x", None, 1)], "source string, entity_id string, kind string, display_name string, name_folded string, v int")
    assert [r.fault for r in W.entity_faults(rows).orderBy("entity_id", "v").collect()] == [None, None, "stale", "incomplete"]
    assert sorted((r.entity_id, r.name_folded) for r in W.upsert_entities(rows, "v").collect()) == [("1", "peru fc"), ("2", "a")]


def test_slices_and_rosters(spark):
    stored = spark.createDataFrame([("m1", "a", 1), ("m1", "a", 1), ("m2", "a", 2), ("m3", "b", 3)], "m string, team string, n int")
    desired = spark.createDataFrame([("m1", "a", 1), ("m2", "a", 2), ("m4", "c", 4)], "m string, team string, n int")
    assert {r.m for r in W.changed_slices(stored, desired, ["m"]).collect()} == {"m1", "m4"}
    assert sorted(W.replace_if_changed(stored, desired, ["m"]).collect()) == [("m1", "a", 1), ("m2", "a", 2), ("m3", "b", 3), ("m4", "c", 4)]
    incoming = spark.createDataFrame([("c", 7, "x", 2), ("c", 7, "y", 1), ("b", 1, "z", 1)], "team string, number int, name string, o int")
    assert W.insert_once(stored, incoming, "team", "number", "o").collect() == [("c", 7, "y", 1)]


def test_adoption(spark):
    events = spark.createDataFrame([("s", "s:1"), ("s", "c2"), ("s", "s:2")], "source string, match_id string")
    pairs = spark.createDataFrame([("s", "s:1", "c1"), ("s", "s:2", "c2")], "source string, stub_id string, canonical_id string")
    judged = {r.stub_id: r.refused for r in W.adoptable(pairs, events).collect()}
    assert judged == {"s:1": False, "s:2": True}
    rows = spark.createDataFrame([("s", "s:1", "A", 1), ("s", "c1", "A", 2), ("s", "c1", "B", 3), ("t", "s:1", "A", 4)], "source string, match_id string, team string, n int")
    assert sorted(W.rekey(rows, pairs, ["source", "match_id", "team"]).collect()) == [("s", "c1", "A", 1), ("s", "c1", "B", 3), ("t", "s:1", "A", 4)]


def test_maps(spark):
    log = spark.createDataFrame([("s", "p", "1", "c1", False, 1), ("s", "p", "1", "c2", False, 2), ("s", "p", "2", "c2", False, 1), ("s", "p", "3", "s:3", False, 1), ("s", "p", "4", "c4", False, 1), ("s", "p", "4", None, True, 2)], "source string, provider string, provider_match_id string, match_id string, deleted boolean, v int")
    entries = W.provider_map(log, "v")
    assert sorted((r.provider_match_id, r.match_id) for r in entries.collect()) == [("1", "c2"), ("2", "c2"), ("3", "s:3")]
    assert [r.provider_match_id for r in W.forbidden_entries(entries).collect()] == ["3"]
    assert {r.match_id: (r.first, r.several) for r in W.reverse_map(entries).collect()} == {"c2": ("1", True), "s:3": ("3", False)}


def test_closed_world(spark):
    with pytest.raises(W.ClosedWorldError):
        W.closed_world(spark.range(1), ("x",))
    assert W.closed_world(spark.range(1), ("id", "x"), ("id",)).count() == 1
    assert W.stamped(spark.createDataFrame([(None,), ("t",)], "source string"), "s").collect() == [("s",), ("t",)]
