"""Queries of the read port and of side tables over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.feed import team_key
from matchloom.operators import readport as R
from matchloom.operators import reads
from matchloom.plans.records import _FOLD, _M, _events, _matches
from matchloom.sources import read_table


def _lineups(s, d):
    """One row per athlete of a match and team."""
    rows = read_table(s, d, "football_lineups").where("team is not null and athlete_id is not null and match_id is not null and source is not null")
    return rows.groupBy("source", "match_id", "team", "athlete_id").agg(*[F.max(c).alias(c) for c in ("display_name", "jersey", "position", "starter", "formation_place")])


def lineup_for_match(s, d):
    """Each row's place in its match's line-up, as a reader gets it."""
    ordered = R.with_source(_lineups(s, d), read_table(s, d, "matches"))
    place = reads.squad(ordered)
    return place.select("source", "match_id", "team", "athlete_id", "display_name", "starter", F.col("place").cast("bigint").alias("place"))


def lineup_team_keys(s, d):
    """Line-ups per team key: how many spellings, rows and matches."""
    return R.keyed_teams(_lineups(s, d)).groupBy(F.md5("team_key").alias("team")).agg(F.count_distinct("team").alias("spellings"), F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"))


def lineup_of_hot_team(s, d):
    """The line-ups of the team whose name comes first."""
    rows = _lineups(s, d)
    name = rows.agg(F.min("team")).first()[0]
    return R.lineup(rows, name).select("source", "match_id", "team", "athlete_id")


def match_venue(s, d):
    m = _matches(s, d)
    rows = m.select("source", "match_id", F.get_json_object("payload", "$.stadium").alias("stadium"), F.get_json_object("payload", "$.city").alias("city")).where("stadium is not null or city is not null")
    return R.side_rows(rows, ("match_id",), source="terrafeed")


def _rosters(s, d):
    rows = _lineups(s, d).where("jersey is not null")
    return rows.groupBy("team", F.col("jersey").alias("number")).agg(F.min("display_name").alias("player_name"))


def roster_order(s, d):
    """Each team's roster by number: the place of every row."""
    rows = R.first_per(_rosters(s, d), ["team"], [F.col("number")], limit=5)
    return rows.select("team", "number", "player_name")


def roster_has(s, d):
    """Which players of the entities stand in the roster of a team of their parent's name."""
    e = read_table(s, d, "entities")
    teams = e.where("kind = 'team'").groupBy("source", F.col("entity_id").alias("parent_entity")).agg(F.min("display_name").alias("participant"))
    asked = e.where("kind = 'player' and display_name is not null").select("source", "parent_entity", F.col("display_name").alias("name")).distinct().join(teams.where("participant is not null"), ["source", "parent_entity"])
    return R.in_roster(_rosters(s, d), asked.select("source", "participant", "name")).groupBy("source", "found").agg(F.count("*").alias("n"))


def players_found(s, d):
    """Each line-up's starters looked up by name in their own match."""
    rows = _lineups(s, d)
    asked = rows.where("starter = 1 and display_name is not null").select("source", "match_id", F.col("display_name").alias("name"))
    return R.player_in_lineup(rows, asked).select("source", "match_id", F.md5("name").alias("name"), "team", "athlete_id")


def commentary(s, d):
    """The three latest documents about each match."""
    docs = read_table(s, d, "documents").where("match_id is not null").select("match_id", F.col("n_chars").alias("created_at"), F.col("doc_id").alias("id"), "source")
    return R.recent_commentary(docs, 3)


def one_entity(s, d):
    rows = read_table(s, d, "entities")
    return R.entity(rows, "pitchwire", "pitchwire:t1000").select("source", "entity_id", "kind", "display_name").distinct()


def side_table_top(s, d):
    """The ten greatest possession rows of all statistics."""
    rows = read_table(s, d, "football_stats").where("team is not null").select("match_id", "team", "possession").distinct()
    return R.side_rows(rows, ("possession desc", "match_id desc", "team desc"), limit=10)


def backfill_skips(s, d):
    """How many of each source's polled matches need no fetch."""
    polled = read_table(s, d, "match_polls").select("source", "match_id").distinct()
    have = read_table(s, d, "match_polls").where("status = 'FINISHED'").select("source", "match_id").distinct()
    return R.skippable(polled, have, _events(s, d)).groupBy("source").agg(F.count("*").alias("n"))


def off_slate(s, d):
    """Stored matches of each source that no poll shows."""
    return R.unknown_to(read_table(s, d, "match_polls").select("source", "match_id"), _matches(s, d, "status").select("source", "match_id"), ["source", "match_id"]).groupBy("source").agg(F.count("*").alias("n"))


def matches_in_order(s, d):
    """The place of every match in the order of the listing."""
    m = _matches(s, d, "kickoff_utc").where("match_id is not null")
    at = Window.partitionBy("source").orderBy(F.asc_nulls_first("kickoff_utc"), "match_id")
    return m.select("source", "match_id", F.row_number().over(at).cast("bigint").alias("place"))


def fold_matches(s, d):
    """Entities found under each display name: how many rows the name's fold leads to."""
    e = read_table(s, d, "entities").select("source", "entity_id", "kind", "display_name", "name_folded").distinct()
    names = e.where("display_name is not null").select(F.col("display_name").alias("name")).distinct().withColumn("f", team_key(F.col("name")))
    return names.join(e.where("name_folded is not null"), F.col("f") == F.col("name_folded")).groupBy(F.md5("name").alias("name")).agg(F.count("*").alias("n"))


_NAMES = "lineup_for_match lineup_team_keys lineup_of_hot_team match_venue roster_order roster_has players_found commentary one_entity side_table_top backfill_skips off_slate matches_in_order fold_matches".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_L = "(select source, match_id, team, athlete_id, max(display_name) as display_name, max(jersey) as jersey, max(position) as position, max(starter) as starter, max(formation_place) as formation_place from football_lineups where team is not null and athlete_id is not null and match_id is not null and source is not null group by 1, 2, 3, 4)"
_KEY = lambda c: _FOLD.replace("display_name", c)
_R = f"(select team, jersey as number, min(display_name) as player_name from {_L} where jersey is not null group by 1, 2)"
ORACLES = {
    "lineup_for_match": f"select source, match_id, team, athlete_id, display_name, starter, row_number() over (partition by source, match_id, team order by formation_place asc nulls last, athlete_id) as place from {_L} l where exists (select 1 from matches m where m.source = l.source and m.match_id = l.match_id)",
    "lineup_team_keys": f"select md5({_KEY('team')}) as team, count(distinct l.team) as spellings, count(*) as n, count(distinct match_id) as matches from {_L} l group by 1",
    "lineup_of_hot_team": f"select source, match_id, team, athlete_id from {_L} where {_KEY('team')} = (select {_KEY('min(team)')} from {_L})",
    "match_venue": f"select source, match_id, p ->> '$.stadium' as stadium, p ->> '$.city' as city from (select source, match_id, case when json_valid(payload) then payload end as p from {_M}) where source = 'terrafeed' and (p ->> '$.stadium' is not null or p ->> '$.city' is not null)",
    "roster_order": f"select * from {_R} qualify row_number() over (partition by team order by number) <= 5",
    "roster_has": f"""with t as (select source, entity_id as parent_entity, min(display_name) as participant from entities where kind = 'team' group by 1, 2), a as (select distinct source, parent_entity, display_name as name from entities where kind = 'player' and display_name is not null),
q as (select a.source, {_KEY('t.participant')} as k, {_KEY('a.name')} as f from a join t using (source, parent_entity) where t.participant is not null), h as (select distinct {_KEY('team')} as k, {_KEY('player_name')} as f from {_R})
select q.source, h.k is not null as found, count(*) as n from q left join h on q.k = h.k and q.f = h.f group by 1, 2""",
    "players_found": f"""with l as {_L}, a as (select distinct source, match_id, display_name as name from l where starter = 1 and display_name is not null)
select a.source, a.match_id, md5(a.name) as name, l.team, l.athlete_id from a join l on a.source = l.source and a.match_id = l.match_id and {_KEY('a.name')} = {_KEY('l.display_name')}
qualify row_number() over (partition by a.source, a.match_id, a.name order by l.team, l.formation_place asc nulls last, l.athlete_id) = 1""",
    "commentary": "select match_id, n_chars as created_at, doc_id as id, source from documents where match_id is not null qualify row_number() over (partition by match_id order by n_chars desc nulls last, doc_id desc) <= 3",
    "one_entity": "select distinct source, entity_id, kind, display_name from entities where source = 'pitchwire' and entity_id = 'pitchwire:t1000'",
    "side_table_top": "select distinct match_id, team, possession from football_stats where team is not null order by possession desc nulls last, match_id desc nulls last, team desc limit 10",
    "backfill_skips": "select source, count(*) as n from (select distinct source, match_id from match_polls p where status = 'FINISHED' and exists (select 1 from event_polls e where e.source = p.source and e.match_id = p.match_id)) group by 1",
    "off_slate": f"select source, count(*) as n from {_M} m where not exists (select 1 from match_polls p where p.source = m.source and p.match_id = m.match_id) group by 1",
    "matches_in_order": f"select source, match_id, row_number() over (partition by source order by kickoff_utc asc nulls first, match_id) as place from {_M} where match_id is not null",
    "fold_matches": f"""with e as (select distinct source, entity_id, kind, display_name, name_folded from entities), n as (select distinct display_name as name from e where display_name is not null)
select md5(n.name) as name, count(*) as n from n join e on {_KEY('n.name')} = e.name_folded group by 1""",
}
