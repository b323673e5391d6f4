"""Queries over provider documents, which are built from the tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import feed as V
from matchloom.functions.columns import lookup
from matchloom.operators import feeds, reads
from matchloom.plans.records import _E, _M, _events, _matches
from matchloom.sources import read_table

# Descriptions and slugs that a provider would send for the stored words.
_DESCRIBED = {"FINISHED": "Full Time", "IN_PLAY": "First Half", "PAUSED": "Halftime", "SCHEDULED": "Scheduled"}
_SLUGS = {
    "yellow": "yellow-card", "red": "yellow-red-card", "sub": "substitution", "goal": "goal---volley",
    "own_goal": "own-goal", "kickoff": "kickoff", "penalty": "penalty", "half_time": "halftime", "full_time": "full-time",
}


def _told(name):
    return F.get_json_object("payload", f"$.{name}")


def _scoreboards(s, d):
    m = _matches(s, d)
    side = lambda n: F.struct(F.lit(n).alias("homeAway"), F.col(f"score_{n}").cast("string").alias("score"), F.struct(_told(f"{n}_team").alias("displayName")).alias("team"))
    kind = F.struct(F.coalesce(F.try_element_at(lookup(_DESCRIBED.items()), F.col("status")), F.lit("Abandoned")).alias("description"))
    comp = F.struct(
        F.struct(F.col("display_clock").alias("displayClock"), kind.alias("type")).alias("status"), F.array(side("home"), side("away")).alias("competitors"),
        F.struct(_told("stadium").alias("fullName"), F.struct(F.concat(_told("city"), F.lit(", Land")).alias("city")).alias("address")).alias("venue"),
    )
    slug = F.struct(F.lower(F.replace(_told("round_name"), F.lit(" "), F.lit("-"))).alias("slug"))
    event = F.struct(F.col("match_id").alias("id"), F.col("kickoff_utc").alias("date"), slug.alias("season"), F.array(comp).alias("competitions"))
    return m.where("match_id is not null").select(F.to_json(F.struct(F.array(event).alias("events"))).alias("raw"))


def scoreboard_scan(s, d):
    rows = feeds.scoreboard_rows(_scoreboards(s, d))
    return rows.select("match_id", "kickoff_utc", "status", "minute", "display_clock", "score_home", "score_away", "home_team", "away_team", "stadium", "city", "round_name")


def _summaries(s, d):
    e = _events(s, d)
    named = lambda c: F.struct(F.struct(c.alias("displayName")).alias("athlete"))
    key = F.struct(
        F.struct(F.try_element_at(lookup(_SLUGS.items()), F.col("type")).alias("type")).alias("type"), F.struct(F.concat(F.col("minute").cast("string"), F.lit("'")).alias("displayValue")).alias("clock"),
        F.struct(_told("team").alias("displayName")).alias("team"), F.array(named(F.coalesce(_told("scorer"), _told("player"))), named(_told("assist"))).alias("participants"), F.col("detail").alias("text"),
    )
    per = e.groupBy("source", "match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", key.alias("k")))), lambda x: x["k"]).alias("k"))
    return feeds.summary_rows(per.select(F.concat_ws("|", "source", "match_id").alias("match_id"), F.to_json(F.struct(F.col("k").alias("keyEvents"))).alias("raw")))


def summary_events(s, d):
    return feeds.event_rows(_summaries(s, d)).select("match_id", "seq", "minute", "type", "importance", "detail", F.get_json_object("payload", "$.team").alias("team"), F.coalesce(_told("scorer"), _told("player")).alias("player"))


def _blocks(rows, keys, build, name):
    """Documents with one list of team blocks per match."""
    per = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(build)).alias("b"))
    return per.select(F.concat_ws("|", *keys).alias("match_id"), F.to_json(F.struct(name(F.col("b")))).alias("raw"))


_STATS = ("shots", "shots_on_target", "corners", "fouls", "yellow_cards", "red_cards", "offsides")


def summary_stats(s, d):
    rows = read_table(s, d, "football_stats").where("team is not null and team <> ''").groupBy("source", "match_id", "team").agg(*[F.max(c).alias(c) for c in ("possession", *_STATS)])
    stat = [F.struct(F.lit(f).alias("name"), F.col(n).cast("string").alias("displayValue")) for f, n in V.STATISTICS.items()]
    block = F.struct(F.struct(F.col("team").alias("displayName")).alias("team"), F.array(*stat).alias("statistics"))
    docs = _blocks(rows, ["source", "match_id"], block, lambda b: F.struct(b.alias("teams")).alias("boxscore"))
    return feeds.stat_rows(feeds.summary_rows(docs))


def summary_lineups(s, d):
    rows = read_table(s, d, "football_lineups").where("team <> '' and display_name <> '' and athlete_id is not null").groupBy("source", "match_id", "team", "athlete_id")
    names = ("display_name", "jersey", "position", "starter", "formation_place")
    one = rows.agg(*[F.max(c).alias(c) for c in names])
    player = F.struct(
        F.struct(F.col("athlete_id").alias("id"), F.col("display_name").alias("displayName")).alias("athlete"), "jersey", F.struct(F.col("position").alias("abbreviation")).alias("position"),
        (F.col("starter") == 1).alias("starter"), F.col("formation_place").cast("string").alias("formationPlace"),
    )
    teams = one.groupBy("source", "match_id", "team").agg(F.array_sort(F.collect_list(player)).alias("roster"))
    docs = _blocks(teams, ["source", "match_id"], F.struct(F.struct(F.col("team").alias("displayName")).alias("team"), "roster"), lambda b: b.alias("rosters"))
    return feeds.lineup_rows(feeds.summary_rows(docs)).select("match_id", "team", "athlete_id", *names)


def venues(s, d):
    rows = feeds.scoreboard_rows(_scoreboards(s, d))
    return feeds.venue_rows(rows)


def squad_rosters(s, d):
    """Squads made of the players that entities list, joined to the line-ups' team texts by team key."""
    e = read_table(s, d, "entities")
    teams = e.where("kind = 'team' and display_name is not null").groupBy(F.col("source").alias("ts"), F.col("entity_id").alias("team_id")).agg(F.min("display_name").alias("name"))
    number, player = F.get_json_object("payload", "$.jersey").try_cast("int"), F.col("display_name")
    players = e.where("kind = 'player'").select(F.col("source").alias("ts"), F.col("parent_entity").alias("team_id"), F.struct(number.alias("number"), _told("position").alias("pos"), player.alias("name"), _told("dob").alias("date_of_birth")).alias("p"))
    squads = teams.join(players, ["ts", "team_id"]).groupBy("ts", "team_id", "name").agg(F.array_sort(F.collect_set("p")).alias("players"))
    first = squads.groupBy("name").agg(F.min_by("players", F.struct("ts", "team_id")).alias("players")).select("name", F.lit(None).cast("string").alias("fifa_code"), F.lit(None).cast("string").alias("group"), "players")
    texts = read_table(s, d, "football_lineups").where("team is not null").select("team")
    return feeds.roster_rows(texts, first).groupBy("team", "number").agg(F.count("*").alias("n"))


def team_names(s, d):
    """Teams as displayed and how often each display name occurs."""
    rows = read_table(s, d, "worldcup").select(F.explode(F.array("team1", "team2")).alias("team")).where("team is not null")
    return rows.select(V.display_name(F.col("team")).alias("team")).groupBy("team").agg(F.count("*").alias("n"))


def scorers(s, d):
    """Who scored, whichever key an event's payload uses."""
    e = _events(s, d).where(F.col("type").isin("goal", "own_goal"))
    return e.select("source", "match_id", "seq", F.get_json_object(F.concat(F.lit("["), V.renamed_scorer(F.col("type"), F.col("payload"))["scorer"], F.lit("]")), "$[0]").alias("scorer"))


def provider_ids(s, d):
    m = _matches(s, d, "status").where("match_id is not null")
    return m.select("source", "match_id", V.provider_id(F.col("source"), F.col("match_id")).alias("provider_id"), V.qualified_id(F.col("source"), V.provider_id(F.col("source"), F.col("match_id"))).alias("qualified"))


def taxonomy(s, d):
    """The declared event types with their importance, and how many rows each has."""
    words = s.createDataFrame([(k, name, n) for k, (name, n) in V.TAXONOMY.items()], "type string, display_name string, importance int")
    counts = read_table(s, d, "event_polls").groupBy("type").agg(F.count("*").alias("n"))
    return words.join(counts, "type", "left").select("type", "display_name", "importance", F.coalesce("n", F.lit(0)).alias("n"))


def standing_order(s, d):
    """Customers per nation as standings of regions, read in stored order."""
    n, c = read_table(s, d, "nation"), read_table(s, d, "customer")
    rows = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("points")).join(n, "n_nationkey")
    table = rows.select(F.lit("s").alias("source"), F.col("n_regionkey").cast("string").alias("group_key"), F.col("n_name").alias("entity_id"), "points", (F.col("n_nationkey") % 3).cast("int").alias("rank"))
    ordered = reads.standings(table, "s")
    return feeds.positions(ordered.withColumn("place", F.struct("group_key", "rank", "entity_id")), ["source"], "place").select("group_key", "entity_id", "points", "rank", "seq")


_NAMES = "scoreboard_scan summary_events summary_stats summary_lineups venues squad_rosters team_names scorers provider_ids taxonomy standing_order".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_P = f"(select *, case when json_valid(payload) then payload end as p from {_M} where match_id is not null)"
ORACLES = {
    "scoreboard_scan": f"""select match_id, kickoff_utc, case when status in ('FINISHED', 'IN_PLAY', 'PAUSED', 'SCHEDULED') then status else 'UNKNOWN' end as status, try_cast(trim(split_part(replace(display_clock, '''', ''), '+', 1)) as int) as minute,
nullif(display_clock, '') as display_clock, score_home, score_away, p ->> '$.home_team' as home_team, p ->> '$.away_team' as away_team, nullif(p ->> '$.stadium', '') as stadium, nullif(p ->> '$.city', '') as city,
array_to_string(list_transform(string_split(replace(lower(p ->> '$.round_name'), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as round_name from {_P}""",
    "summary_events": f"""with e as {_E}, k as (select *, row_number() over w - 1 + coalesce(sum(case when type = 'red' then 1 else 0 end) over (partition by source, match_id order by seq rows between unbounded preceding and 1 preceding), 0) as pos from e window w as (partition by source, match_id order by seq)),
x as (select *, pos as seq2, type as t2, detail as d2 from k where type <> 'red' union all select *, pos, 'yellow', 'Second yellow card' from k where type = 'red' union all select *, pos + 1, 'red', detail from k where type = 'red')
select source || '|' || match_id as match_id, cast(seq2 as int) as seq, minute, t2 as type, map {{'goal': 1, 'own_goal': 1, 'penalty': 1, 'yellow': 3, 'red': 2, 'sub': 4, 'kickoff': 3, 'half_time': 3, 'full_time': 2}}[t2] as importance,
nullif(d2, '') as detail, payload ->> '$.team' as team, coalesce(payload ->> '$.scorer', payload ->> '$.player') as player from x""",
    "summary_stats": f"select source || '|' || match_id as match_id, team, max(possession) as possession, {', '.join(f'max({c}) as {c}' for c in _STATS)} from football_stats where team <> '' and source is not null and match_id is not null group by 1, 2",
    "summary_lineups": "select source || '|' || match_id as match_id, team, athlete_id, max(display_name) as display_name, max(jersey) as jersey, max(position) as position, coalesce(max(starter), 0) as starter, max(formation_place) as formation_place from football_lineups where team <> '' and display_name <> '' and athlete_id is not null group by 1, 2, 3",
    "venues": f"select match_id, nullif(p ->> '$.stadium', '') as stadium, nullif(p ->> '$.city', '') as city from {_P} where nullif(p ->> '$.stadium', '') is not null or nullif(p ->> '$.city', '') is not null",
    "squad_rosters": """with f as (select *, replace(lower(strip_accents(nfc_normalize(trim(display_name)))), 'ß', 'ss') as key from entities where kind = 'team' and display_name is not null),
t as (select source, entity_id, min(display_name) as name from f group by 1, 2), p as (select source, parent_entity as team_id, try_cast(payload ->> '$.jersey' as int) as number, display_name from entities where kind = 'player' and json_valid(payload)),
s as (select t.name, t.source, t.entity_id, number, display_name from t join p on p.source = t.source and p.team_id = t.entity_id), o as (select name, min((source, entity_id)) as first from s group by 1),
k as (select replace(lower(strip_accents(nfc_normalize(trim(s.name)))), 'ß', 'ss') as key, number from s join o on o.name = s.name and (s.source, s.entity_id) = o.first where number is not null and display_name is not null)
select distinct l.team, k.number, cast(1 as bigint) as n from (select distinct team from football_lineups where team is not null) l join k on replace(lower(strip_accents(nfc_normalize(trim(l.team)))), 'ß', 'ss') = k.key""",
    "team_names": "select case team when 'Türkiye' then 'Turkey' when 'United States' then 'USA' when 'Korea Republic' then 'South Korea' when 'IR Iran' then 'Iran' when 'Côte d''Ivoire' then 'Ivory Coast' else team end as team, count(*) as n from (select unnest([team1, team2]) as team from worldcup) where team is not null group by 1",
    "scorers": f"select source, match_id, seq, coalesce(payload ->> '$.scorer', payload ->> '$.player') as scorer from {_E} where type in ('goal', 'own_goal')",
    "provider_ids": f"select source, match_id, case when starts_with(match_id, source || ':') then substr(match_id, length(source) + 2) else match_id end as provider_id, source || ':' || case when starts_with(match_id, source || ':') then substr(match_id, length(source) + 2) else match_id end as qualified from {_M} where match_id is not null",
    "taxonomy": """select t.type, t.display_name, t.importance, count(e.type) as n from (values ('goal', 'Goal', 1), ('own_goal', 'Own goal', 1), ('penalty', 'Penalty', 1), ('yellow', 'Yellow card', 3), ('red', 'Red card', 2), ('sub', 'Substitution', 4),
('kickoff', 'Kickoff', 3), ('half_time', 'Half time', 3), ('full_time', 'Full time', 2)) t(type, display_name, importance) left join event_polls e using (type) group by 1, 2, 3""",
    "standing_order": """with r as (select cast(n_regionkey as varchar) as group_key, n_name as entity_id, n_nationkey, count(*) as points from customer join nation on c_nationkey = n_nationkey group by 1, 2, 3)
select group_key, entity_id, points, cast(n_nationkey % 3 as int) as rank, cast(row_number() over (order by group_key, n_nationkey % 3, entity_id) - 1 as int) as seq from r""",
}
