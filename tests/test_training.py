"""Orphans, instants, nested records and snapshots on small cases."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from matchloom.operators.instants import iso_utc, normalise_moments, parse_moments
from matchloom.operators.nested import flatten_records
from matchloom.operators.orphans import Parent, Reference, find_orphans
from matchloom.operators import snapshots
from matchloom.operators.snapshots import snapshot_changes

MATCH = "match_id string, source string, kickoff_utc string, payload string, extra string"
CUP = "wc_id bigint, date string, time string, goals1 array<struct<name:string,minute:string>>, goals2 array<struct<name:string,minute:string>>"


def moment(spark, texts, source="kikt", tz=None):
    rows = [(str(k), source, t, json.dumps({"venue_tz": tz}) if tz else None, "x") for k, t in enumerate(texts)]
    found = normalise_moments(spark.createDataFrame(rows, MATCH), spark.createDataFrame([], CUP)).collect()
    by = {r.rec_key: r.instant_utc for r in found}
    return [by.get(str(k)) for k in range(len(texts))]


def test_formats(spark):
    texts = ["2019-04-04T16:30Z", "1543636800", "1497600053999", "20161019T170000+0100", "2016-09-20 13:00 UTC+1", "2016-11-06 15:00 UTC−6",
             "2018-01-12 19:00 UTC+5:30", "Sun, 27 Oct 2024 01:45:00 +0100", "22 December 2016, 9:00 pm UTC-8", "04 Dec 2025 21:00 WET", "01 Sep 2022 21:00 JST",
             "2016-09-11T15:30-05:00[America/Bogota]", "2022-08-28T20:00:00.329931+09:00", "2019-08-17 22:30", "16/05/2020 17:30 +03:00"]
    assert moment(spark, texts) == [
        "2019-04-04T16:30:00Z", "2018-12-01T04:00:00Z", "2017-06-16T08:00:53Z", "2016-10-19T16:00:00Z", "2016-09-20T12:00:00Z", "2016-11-06T21:00:00Z",
        "2018-01-12T13:30:00Z", "2024-10-27T00:45:00Z", "2016-12-23T05:00:00Z", "2025-12-04T21:00:00Z", "2022-09-01T12:00:00Z",
        "2016-09-11T20:30:00Z", "2022-08-28T11:00:00Z", "2019-08-17T22:30:00Z", "2020-05-16T14:30:00Z",
    ]


def test_unreadable(spark):
    bad = [None, "", "  ", "TBD", "2019-11-04", "2021-02-30T10:00Z", "2021-01-01T25:00Z", "2021-01-01 13:00 pm UTC", "10:00 UTC", "2021-01-01T10:00 Mars/Base", "x" * 50_000]
    assert moment(spark, bad) == [None] * len(bad)


def test_month_first(spark):
    assert moment(spark, ["03/04/2021 10:00 AM +00:00"], "stadia9") == ["2021-03-04T10:00:00Z"]
    assert moment(spark, ["03/04/2021 10:00 AM +00:00"], "kikt") == ["2021-04-03T10:00:00Z"]


def test_local_times_against_zoneinfo(spark):
    dice = random.Random(5)
    zone = ZoneInfo("Europe/Berlin")
    times = [dt.datetime(2021, 10, 31, 2, 30), *(dt.datetime(2016, 1, 1) + dt.timedelta(minutes=dice.randrange(5_000_000)) for _ in range(60))]
    times = [t for t in times if t.replace(tzinfo=zone).astimezone(dt.UTC).astimezone(zone).replace(tzinfo=None) == t]  # the skipped hour has its own rule
    want = [t.replace(tzinfo=zone, fold=0).astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for t in times]
    assert moment(spark, [t.strftime("%d.%m.%Y %H:%M") for t in times], tz="Europe/Berlin") == want
    assert moment(spark, ["28.03.2021 02:30"], tz="Europe/Berlin") == ["2021-03-28T01:30:00Z"]


def test_session_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2021-07-01T10:00+02:00",)], "k string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert parse_moments(df, "i", F.col("k"), F.lit(False), F.lit("UTC")).select(iso_utc(F.col("i"))).first()[0] == "2021-07-01T08:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_worldcup_needs_a_zone(spark):
    cup = spark.createDataFrame([(1, "Wed 20 Jun 2018", "9:00 p.m. UTC+1", None, None), (2, "2018-06-20", "21:00", None, None), (3, "June 05, 2017", "23.30 UTC-5", None, None), (4, "2018-06-20", "20:30 America/Chicago", None, None)], CUP)
    found = {r.rec_key: r.instant_utc for r in normalise_moments(spark.createDataFrame([], MATCH), cup).collect()}
    assert found == {"1": "2018-06-20T20:00:00Z", "3": "2017-06-06T04:30:00Z", "4": "2018-06-21T01:30:00Z"}


def flat(spark, payloads, cup=()):
    matches = spark.createDataFrame([(f"m{k}", "kikt", None, p, "x") for k, p in enumerate(payloads)], MATCH)
    return sorted(tuple(r) for r in flatten_records(matches, spark.createDataFrame(list(cup), CUP)).collect())


def test_nested_shapes(spark):
    player = {"display_name": "A", "athlete_id": 7}
    payloads = [
        json.dumps({"lineups": [None, {"players": [None, player, {"athlete_id": "8"}]}]}),
        json.dumps({"lineups": {"away": {"players": player}, "home": {"players": []}}}),
        json.dumps(json.dumps({"rosters": [{"roster": [{"athlete": {"displayName": "B", "id": "9"}}]}], "boxscore": {"teams": [None, {"team": {"displayName": "T"}}]}})),
        json.dumps({"stats": {"team": "S"}}), '{"lineups": [{"players": [{"display_name": "cut', "not json", "", None, "[]", '{"stats": null, "lineups": null}',
    ]
    assert flat(spark, payloads) == sorted([
        ("matches", "m0", "players", 1, 1, "A", "7"), ("matches", "m0", "players", 1, 2, "", "8"), ("matches", "m1", "players", 1, 0, "A", "7"),
        ("matches", "m2", "players", 0, 0, "B", "9"), ("matches", "m2", "stats", 1, -1, "T", ""), ("matches", "m3", "stats", 0, -1, "S", ""),
    ])


def test_nested_long_list_and_nulls(spark):
    goals = [(f"n{k}", None) if k % 3 else None for k in range(5000)]
    found = flat(spark, [], [(1, None, None, goals, None), (1, None, None, goals, None), (2, None, None, [], [None])])
    assert found == sorted(("worldcup", "1", "goals1", k, -1, f"n{k}", "") for k in range(5000) if k % 3)


REF = "source string, match_id string, collected_at timestamp_ntz, tab string"
PAR = "source string, match_id string, deleted_at timestamp_ntz, bits string"


def test_orphans_brute_force(spark):
    dice = random.Random(3)
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=d) for d in range(90)]
    refs = [(dice.choice(["a", "b", None]), dice.choice([None, "", " ", " ", *map(str, range(400))]), dice.choice([*days, None]), "x") for _ in range(6000)]
    parents = [("a", str(k), None if k % 3 else days[0], "y") for k in range(0, 400, 2)]
    rows = spark.createDataFrame(refs, REF)
    out = find_orphans([Reference("t", "match_id", "m", rows, scoped=False)], [Parent("m", spark.createDataFrame(parents, PAR), "match_id", scoped=False)], ranges=3)
    living = {k for _, k, gone, _ in parents if gone is None}
    first = {}
    for s, k, at, _ in refs:
        if k and k.strip() and k not in living:
            old = first.get((s, k))
            first[s, k] = min(x for x in (old, at) if x) if old or at else None
    want = {("t", "match_id", s, k, at and at.strftime("%Y-%m")) for (s, k), at in first.items()}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    none = find_orphans([Reference("t", "match_id", "m", rows.limit(0), scoped=False)], [Parent("m", spark.createDataFrame(parents, PAR), "match_id", scoped=False)])
    assert none.count() == 0


POLL = "snapshot_no int, polled_at timestamp_ntz, source string, match_id string, status string, block string"


@pytest.mark.parametrize(("blocks", "run"), [(1, 64), (5, 64), (1, 1), (5, 2), (40, 3)])
def test_snapshots_brute_force(spark, monkeypatch, blocks, run):
    monkeypatch.setattr(snapshots, "RUN", run)
    dice = random.Random(blocks)
    base = dt.datetime(2021, 1, 1)
    rows = []
    for n in range(1, 9):
        for s in ("a", "b"):
            if (s, n) in {("a", 3), ("b", 1)}:
                continue
            for k in range(30):
                if dice.random() < 0.7:
                    rows += [(n, base + dt.timedelta(seconds=dice.randrange(100)), s, f"k{k}" if k else None, dice.choice(["x", "y", None]), "z") for _ in range(dice.choice([1, 1, 2]))]
    best = {}
    for n, at, s, k, v, _ in rows:
        mark = (at, v is not None, v or "")
        if (s, n, k) not in best or mark > best[s, n, k][0]:
            best[s, n, k] = (mark, v)
    want = set()
    for s in ("a", "b"):
        seen = sorted({n for x, n, _ in best if x == s})
        for old, new in zip(seen, seen[1:], strict=False):
            was, now = ({k: v for (x, n, k), (_, v) in best.items() if x == s and n == m} for m in (old, new))
            want |= {("match_polls", s, new, k, -1, "added") for k in now.keys() - was.keys()} | {("match_polls", s, new, k, -1, "removed") for k in was.keys() - now.keys()}
            want |= {("match_polls", s, new, k, -1, "changed") for k in now.keys() & was.keys() if now[k] != was[k]}
    polls = spark.createDataFrame(rows, POLL)
    got = snapshot_changes({"match_polls": (polls, False, ("status",))}, blocks=blocks).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert snapshot_changes({"match_polls": (polls.limit(0), False, ("status",))}).count() == 0
