"""Recordings, the registry and its command line, backfill."""

import json

import pytest

from matchloom import registry as G
from matchloom.operators import backfill as B
from matchloom.sources import recordings as R
from matchloom.sources.store import Store


def test_recordings_come_back(spark, tmp_path):
    matches = spark.createDataFrame([("a:1/ü", "FINISHED", 90, 1, 0, "FT", "A", "B", None, '{"x": 1}'), ("b", "UNKNOWN", *[None] * 8)], R.MATCH[7:-1].replace(":", " ").replace(",", ", "))
    events = spark.createDataFrame([("a:1/ü", 2, 5, "goal", 1, "A", "P", None, None), ("a:1/ü", 0, None, "kickoff", 3, None, None, None, None)], "match_id string, " + R.EVENT[7:-1].replace(":", " ").replace(",", ", "))
    R.write_recordings(matches, events, str(tmp_path / "out"))
    back = R.read_recordings(spark, str(tmp_path / "out"))
    assert sorted(back[0].collect(), key=str) == sorted(matches.collect(), key=str) and sorted(back[1].collect(), key=str) == sorted(events.select(*back[1].columns).collect(), key=str)
    assert len(list((tmp_path / "out").glob("stem=*"))) == 2


@pytest.mark.parametrize(
    ("change", "fault"),
    [({"format_version": 2}, "version"), ({"match": {"status": "FINISHED"}}, "no match"), ({"match": {"match_id": "m", "status": "x"}}, "state"), ({"events": [{"seq": 1}, {"seq": 1}]}, "seq"), ({"events": [{"seq": None}]}, "seq"), ({"events": [{"seq": 2}, {"seq": 1}]}, "order"), ({}, None)],
)
def test_faults_of_recordings(spark, tmp_path, change, fault):
    document = {"format_version": 1, "match": {"match_id": "m", "status": "FINISHED"}, "events": [{"seq": 1}, {"seq": 3}]} | change
    (tmp_path / "r.json").write_text(json.dumps(document, indent=1))
    assert [r.fault for r in R.recordings(spark, str(tmp_path)).collect()] == [fault]
    if fault:
        with pytest.raises(R.RecordingError, match=fault):
            R.read_recordings(spark, str(tmp_path))


def test_registry():
    one, two = G.Operation("a", print), G.Operation("tools", print)
    with pytest.raises(G.RegistryError):
        G.registry([one], [one])
    with pytest.raises(G.RegistryError):
        G.usable([two])
    assert list(G.usable([one], [two, one, G.Operation("b", print)])) == ["a", "b"]
    told = G.manifest(G.registry(G.CORE, G.FOOTBALL))
    assert told["contract_version"] == 1 and [o["name"] for o in told["operations"]] == ["matches", "state", "events", "standings", "vocabulary", "squad", "player-stats"]
    assert told["operations"][2]["params"][1] == {"name": "since_seq", "type": "int", "required": False, "default": -1}
    assert G.discovered("matchloom.none") == []


def test_store_path(monkeypatch):
    monkeypatch.setenv("MATCHLOOM_STORE", "/x")
    assert (G.store_path("/y"), G.store_path()) == ("/y", "/x")
    monkeypatch.delenv("MATCHLOOM_STORE")
    assert G.store_path().endswith("/matchloom")


def test_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path / "s")
    store = Store.create(spark, folder, {"matches": "match_id string, source string, status string, kickoff_utc string", "events": "match_id string, seq int, type string", "football_lineups": "match_id string, team string, athlete_id string, formation_place int"})
    store.publish({
        "matches": spark.createDataFrame([("m2", "s", "FINISHED", "b"), ("m1", "s", "FINISHED", None), ("m3", "t", "FINISHED", "a")], "match_id string, source string, status string, kickoff_utc string"),
        "events": spark.createDataFrame([("m1", k, "goal") for k in range(3)], "match_id string, seq int, type string"),
        "football_lineups": spark.createDataFrame([("m1", "Türkiye", "2", None), ("m1", "Turkey", "1", 3), ("m1", "B", "1", 1)], "match_id string, team string, athlete_id string, formation_place int"),
    })
    run = lambda *a: (G.main([*a, "--store", folder], spark), capsys.readouterr().out.splitlines())[1]
    assert [json.loads(x)["match_id"] for x in run("matches", "--source", "s", "--json")] == ["m1", "m2"]
    assert run("events", "m1", "--since-seq", "1") == ["m1\t2\tgoal"] and run("events", "m1", "--since-seq", "9") == []
    assert run("squad", "m1", "--team", "Turkey") == ["m1\tTurkey\t1\t3", "m1\tTürkiye\t2\t"]
    assert len(run("vocabulary")) == 9 and json.loads(run("state", "m3", "--json")[0])["source"] == "t"
    G.main(["tools"])
    assert json.loads(capsys.readouterr().out)["operations"]


def test_backfill(spark):
    schedule = spark.createDataFrame([("s", m, st, "20200102") for m, st in (("1", "FINISHED"), ("2", "FINISHED"), ("3", "IN_PLAY"), ("4", "FINISHED"), ("5", "FINISHED"), ("6", "FINISHED"))] + [("s", "7", "FINISHED", "20190101")], "source string, match_id string, status string, day string")
    days = B.chunks(spark.sql("select date'2020-01-02' as a, date'2020-01-03' as b"), "a", "b")
    assert sorted(r.day for r in days.collect()) == ["20200101", "20200102", "20200103", "20200104"]
    assert B.chunks(spark.sql("select date'2020-01-04' as a, date'2020-01-03' as b"), "a", "b").count() == 0
    keys = lambda *rows: spark.createDataFrame(list(rows), "source string, match_id string")
    planned = B.plan(schedule, days, keys(("s", "1"), ("s", "2"), ("t", "4")), keys(("s", "1"), ("t", "4")))
    details = spark.createDataFrame([("s", "2", None), ("s", "4", "broken"), ("t", "6", None)], "source string, match_id string, fault string")
    assert {r.match_id: r.outcome for r in B.apply(planned, details).collect()} == {"1": "skipped", "2": "applied", "4": "failed", "5": "failed", "6": "foreign"}
    assert [tuple(r) for r in B.tallies(B.apply(planned, details)).collect()] == [("s", 5, 1, 1, 2, 1)]
