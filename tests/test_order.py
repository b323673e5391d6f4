"""Reads that promise an order give it."""

from matchloom.operators import readport, reads


def test_matches_by_text_then_id(spark):
    rows = [("m3", "s", "b"), ("m1", "s", None), ("m2", "s", None), ("m4", "s", "a"), ("m5", "t", "a")]
    df = spark.createDataFrame([(m, s, k, "FINISHED") for m, s, k in rows], "match_id string, source string, kickoff_utc string, status string").repartition(3)
    assert [r.match_id for r in reads.list_matches(df, source="s").collect()] == ["m1", "m2", "m4", "m3"]
    assert reads.list_matches(df, status="x").collect() == []


def test_events_by_seq(spark):
    df = spark.createDataFrame([("m", k) for k in (10, 2, 33, 4)] + [("n", 1)], "match_id string, seq int").repartition(3)
    assert [r.seq for r in reads.events_since(df, "m", 2).collect()] == [4, 10, 33]
    assert reads.events_since(df, "m", 33).collect() == []


def test_standings_and_lineups(spark):
    table = spark.createDataFrame([("s", "B", "x", 1), ("s", "A", "z", 2), ("s", "A", "y", 2), ("s", "A", "w", 3), ("t", "A", "q", 1)], "source string, group_key string, entity_id string, rank int").repartition(3)
    assert [r.entity_id for r in reads.standings(table, "s").collect()] == ["y", "z", "w", "x"] and [r.entity_id for r in reads.standings(table, "s", "B").collect()] == ["x"]
    rows = spark.createDataFrame([("m", "B", "1", None), ("m", "B", "2", 3), ("m", "A", "3", None), ("m", "B", "0", None), ("m", "B", "9", 1)], "match_id string, team string, athlete_id string, formation_place int").repartition(3)
    assert [r.athlete_id for r in readport.lineup(rows).collect()] == ["3", "9", "2", "0", "1"]


def test_side_tables(spark):
    import pytest

    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, n int").repartition(3)
    assert [r.k for r in readport.side_rows(df, ("n",)).collect()] == ["b", "a", "c"] and [r.k for r in readport.side_rows(df, ("n desc",), limit=2).collect()] == ["c", "a"]
    for bad in (("x",), ("n; drop",), ("n up",)):
        with pytest.raises(readport.UnknownName):
            readport.side_rows(df, bad)
    with pytest.raises(readport.UnknownName):
        readport.side_rows(df, zz="1")
    assert readport.recent_commentary(None) is None
    comments = spark.createDataFrame([("m", f"t{k // 2}", k) for k in range(6)], "match_id string, created_at string, id int")
    assert sorted(r.id for r in readport.recent_commentary(comments, 3).collect()) == [3, 4, 5]
