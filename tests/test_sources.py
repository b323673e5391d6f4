"""Readers of optional and older inputs, paced replay."""

import json

from matchloom.operators.changes import replay, same_rows
from matchloom.sources import read_table
from matchloom.sources.replay import StepReader
from matchloom.sources.tables import imported_squads, optional_json


def test_optional_json(spark, tmp_path):
    schema = "name string, players array<struct<number:int,name:string>>"
    assert optional_json(spark, str(tmp_path / "gone.json"), schema).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"name": "A", "players": [{"number": 1, "name": "x"}]}, {"name": "B"}]))
    assert optional_json(spark, str(tmp_path / "s.json"), schema).count() == 2


def test_both_shapes_of_squads(spark):
    rosters = spark.createDataFrame([("A", "x", 7, "G"), ("A", "x", 7, "G")], "team string, player_name string, number int, position string")
    lineups = spark.createDataFrame([("A", "1", "y", "9")], "team string, athlete_id string, display_name string, jersey string")
    assert [tuple(r) for r in imported_squads(None, rosters).collect()] == [("A", None, "x", "7", "G")]
    assert [tuple(r) for r in imported_squads(lineups, rosters).collect()] == [("A", "1", "y", "9", None)]


def test_paced_replay_is_the_batch_replay(spark, folder):
    polls = read_table(spark, folder, "event_polls")
    match = polls.groupBy("match_id").count().orderBy("count", ascending=False).first().match_id
    reader = StepReader({"path": f"{folder}/event_polls.parquet", "match_id": match, "speed": "60"})
    now = [reader.began]
    reader.clock = lambda: now[0]
    offset, seen = reader.initialOffset(), []
    rows = spark.createDataFrame(reader.rows, "source string, match_id string, seq int, minute int, type string, importance int, detail string, payload string")
    for elapsed in (0.0, 10.0, 30.0, 95.0):
        now[0] = reader.began + elapsed
        more, offset = reader.read(offset)
        seen += list(more)
        assert same_rows(spark.createDataFrame(seen, rows.schema), replay(rows, elapsed, 60.0))
    assert offset["revealed"] == len(seen) == len(reader.rows)
