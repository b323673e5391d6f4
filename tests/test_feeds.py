"""Provider documents with their oddities, and the functions on their values."""

import json

import pytest
from pyspark.sql import functions as F

from matchloom.functions import feed as V
from matchloom.functions import text as T
from matchloom.operators import feeds


def values(spark, build, texts, kind="variant"):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    column = F.parse_json("t") if kind == "variant" else F.col("t")
    return [r.x for r in df.select("k", build(column).alias("x")).orderBy("k").collect()]


def test_json_values(spark):
    texts = ["2", '"2"', '" 07 "', "2.9", "true", '"2.0"', '"x"', "[1]", "{}", "null", "-1", '""']
    assert values(spark, V.whole, texts) == [2, 2, 7, 2, 1, None, None, None, None, None, -1, None]
    assert values(spark, V.number, texts) == [2.0, 2.0, 7.0, 2.9, 1.0, 2.0, None, None, None, None, -1.0, None]
    assert values(spark, V.scalar_text, texts)[:5] == ["2", "2", " 07 ", "2.9", "True"]
    assert values(spark, V.pen_score, ["4", "4.0", "2.5", "-1", '"4"', "true", "null", "1e999" if False else "0"]) == [4, 4, None, None, None, None, None, 0]
    assert values(spark, V.feed_id, ["7", '" 7 "', '""', '"  "', "true", "1.5", "null", "{}"]) == ["7", "7", None, None, None, None, None, None]


def test_keys(spark):
    texts = ["760421.0", "760421.", "760421", "01", ".5", ".0", "-0.0", "+007.00", "1E2", " 7.0 ", "1.50", "9" * 60 + ".0", None]
    assert values(spark, V.key_text, texts, "text") == ["760421", "760421", "760421", "01", ".5", "0", "0", "7", "1E2", " 7.0 ", "1.50", "9" * 60, None]
    assert values(spark, V.identifier, ["7.0", '"7.0"', "true", "[]", '"a"']) == ["7", "7", None, None, "a"]


def test_names_and_words(spark):
    assert values(spark, V.round_name, ["group-stage", "round-of-32", "3rd-place", "", None], "text") == ["Group Stage", "Round Of 32", "3Rd Place", None, None]
    assert values(spark, V.team_key, ["Türkiye", "Turkey", "Côte d'Ivoire", " Perú "], "text") == ["turkey", "turkey", "ivory coast", "peru"]
    assert values(spark, V.event_type, ["own-goal---header", "own---x", "goal---penalty", "goalkeeper-save", "penalty", "halftime", "start-delay", None], "text") == ["own_goal", "own_goal", "goal", None, "penalty", "half_time", None, None]
    assert values(spark, lambda c: T.status_of(c), ["HT", "ht", "Halftime", "LIVE", "x", None], "text") == ["PAUSED", "UNKNOWN", "PAUSED", "IN_PLAY", "UNKNOWN", "UNKNOWN"]
    assert values(spark, lambda c: T.status_of(c, F.lit("in")), ["End of Extra Time", "Half Time"], "text") == ["IN_PLAY", "PAUSED"]
    assert values(spark, lambda c: V.result_type(c, F.lit("post")), ["Final Score - After Penalties", "After Extra Time", "Full Time", None], "text") == ["penalties", "extra_time", "regulation", "regulation"]
    assert values(spark, T.possession_of, ["46%", " 28.4 ", "x", None], "text") == [46.0, 28.4, None, None]
    assert values(spark, T.city_of, ["Houston, Texas", "Bern", None], "text") == ["Houston", "Bern", None]
    assert values(spark, lambda c: V.provider_id(F.lit("s"), c), ["s:7", "t:7", "7"], "text") == ["7", "t:7", "7"]


def side(name, where, score, **more):
    return {"homeAway": where, "team": {"displayName": name}, "score": score, **more}


def test_scoreboard(spark):
    event = {
        "id": 760, "date": "2026-06-18T22:00Z", "season": {"slug": "group-stage"},
        "competitions": [{
            "status": {"displayClock": "90'+6'", "type": {"description": "After Penalties", "state": "post"}}, "venue": {"fullName": "Park", "address": {"city": "Houston, Texas"}},
            "competitors": [side("A", "home", "1", shootoutScore=2.0, winner=False), side("B", "away", "1", shootoutScore=4, winner=True), side("C", "home", 3, shootoutScore=5)],
        }],
    }
    docs = [json.dumps({"events": [event, {"id": "  "}, {"id": True, "competitions": [{}]}, {"id": "9"}]}), "<html>", None, '{"events": []}', '{"events": {}}']
    rows = feeds.scoreboard_rows(spark.createDataFrame([(d,) for d in docs], "raw string")).collect()
    good = next(r for r in rows if r.match_id == "760")
    assert (good.status, good.minute, good.display_clock, good.home_team, good.score_home, good.away_team, good.score_away) == ("FINISHED", 90, "90'+6'", "C", 3, "B", 1)
    assert (good.stadium, good.city, good.round_name, good.score_pen_home, good.score_pen_away, good.pen_winner_side, good.result_type, good.fault) == ("Park", "Houston", "Group Stage", 5, 4, "away", "penalties", None)
    assert sorted(r.fault for r in rows if r.fault) == ["no competition", "no id", "no id", "no scoreboard", "no scoreboard", "no scoreboard"]


SUMMARY = {
    "header": {"competitions": [{"date": "d", "status": {"type": {"description": "First Half"}}, "competitors": [side("Türkiye", "home", "2", linescores=[{"displayValue": "1"}]), side("B", "away", None)]}, {"status": {}}]},
    "gameInfo": None,
    "keyEvents": [
        {"type": {"type": "kickoff"}, "clock": None}, None, {"type": {"type": "save"}},
        {"type": {"type": "yellow-red-card"}, "clock": {"displayValue": "27'"}, "team": {"displayName": "B"}, "participants": [{"athlete": {"displayName": "P"}}, None], "text": "off"},
        {"type": {"type": "goal---volley"}, "clock": {"displayValue": "45'+2'"}, "team": None, "participants": [{"athlete": {"displayName": "S"}}, {"athlete": {"displayName": "Q"}}], "text": "", "shortText": "in"},
    ],
    "boxscore": {"teams": [{"team": {"displayName": "B"}, "statistics": [{"name": "possessionPct", "displayValue": "46%"}, {"name": "totalShots", "displayValue": "7"}, {"name": "totalShots", "displayValue": "8"}, {"name": "x"}]}, {"team": {}}, {"team": {"displayName": "B"}, "statistics": [{"name": "offsides", "displayValue": "1"}]}]},
    "rosters": [
        {"team": {"displayName": "Türkiye"}, "homeAway": "home", "formation": "4-4-2", "roster": [
            {"athlete": {"id": 7, "displayName": "X"}, "jersey": 9, "position": {"abbreviation": "F"}, "starter": True, "formationPlace": "1"}, {"athlete": {"id": 8}}, None, {"athlete": {"id": "7.0", "displayName": "Y"}, "subbedIn": True}]},
        {"team": {"displayName": ""}, "roster": []}, {"team": {"displayName": "B"}, "roster": None},
    ],
    "commentary": [{"text": " a "}, {"text": " "}, "b", None, {"text": "c"}],
}


@pytest.fixture(scope="module")
def summaries(spark):
    return feeds.summary_rows(spark.createDataFrame([("1", json.dumps(SUMMARY)), ("2", "{}"), ("3", "x"), ("4", None)], "match_id string, raw string"))


def test_summary(summaries):
    rows = {r.match_id: r for r in summaries.collect()}
    r = rows["1"]
    assert (r.status, r.home_team, r.score_home, r.score_ht_home, r.score_away, r.kickoff_utc, r.commentary, r.fault) == ("IN_PLAY", "Türkiye", 2, 1, None, "d", ["a", "c"], None)
    assert (rows["2"].status, rows["2"].fault, rows["2"].events, rows["3"].fault, rows["4"].fault) == ("UNKNOWN", None, [], "no summary", "no summary")


def test_rows_of_summaries(spark, summaries):
    events = [(e.seq, e.type, e.minute, e.importance, e.detail, json.loads(e.payload)) for e in feeds.event_rows(summaries).orderBy("seq").collect()]
    assert events == [
        (0, "kickoff", None, 3, None, {}), (1, "yellow", 27, 3, "Second yellow card", {"team": "B", "player": "P"}), (2, "red", 27, 2, "off", {"team": "B", "player": "P"}),
        (3, "goal", 45, 1, "in", {"scorer": "S", "assist": "Q"}),
    ]
    assert [(r.team, r.possession, r.shots, r.offsides) for r in feeds.stat_rows(summaries).collect()] == [("B", None, None, 1)]
    assert [(r.team, r.athlete_id, r.display_name, r.subbed_in, r.jersey) for r in feeds.lineup_rows(summaries).collect()] == [("Turkey", "7", "Y", 1, None)]
    assert feeds.venue_rows(summaries).count() == 0
    squads = spark.createDataFrame([("Turkey", "TUR", "A", [(9, "F", "X", None), (9, "F", "Z", None), (None, "G", "W", None)])], "name string, fifa_code string, group string, players array<struct<number:int,pos:string,name:string,date_of_birth:string>>")
    found = feeds.roster_rows(spark.createDataFrame([("Türkiye",), ("Peru",)], "team string"), squads).collect()
    assert [(r.team, r.number, r.player_name, r.fifa_code) for r in found] == [("Türkiye", 9, "Z", "TUR")]


def test_scorers_of_older_rows(spark):
    rows = [("goal", '{"player": "P", "team": "T"}'), ("goal", '{"player": "P", "scorer": "S"}'), ("sub", '{"player": "P"}'), ("goal", "x")]
    found = [r.m for r in spark.createDataFrame(rows, "type string, payload string").select(V.renamed_scorer(F.col("type"), F.col("payload")).alias("m")).collect()]
    assert found == [{"scorer": '"P"', "team": '"T"'}, {"player": '"P"', "scorer": '"S"'}, {"player": '"P"'}, {}]
