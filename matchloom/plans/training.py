"""Queries p2 to p5 with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators.instants import normalise_moments
from matchloom.operators.nested import flatten_records
from matchloom.operators.orphans import Parent, Reference, find_orphans
from matchloom.operators.snapshots import snapshot_changes
from matchloom.sources import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to records that do not exist, per table, source and month."""
    matches, entities = read_table(spark, folder, "matches"), read_table(spark, folder, "entities")
    references = [
        Reference("matches", "home_entity", "entity", matches, scoped=True),
        Reference("entities", "parent_entity", "entity", entities, scoped=True),
        Reference("football_stats", "match_id", "match", read_table(spark, folder, "football_stats"), scoped=False),
        Reference("football_lineups", "match_id", "match", read_table(spark, folder, "football_lineups"), scoped=False),
    ]
    parents = [Parent("entity", entities, "entity_id", scoped=True), Parent("match", matches, "match_id", scoped=False)]
    return find_orphans(references, parents)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC instant per record of matches and worldcup."""
    return normalise_moments(read_table(spark, folder, "matches"), read_table(spark, folder, "worldcup"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Goals, line-ups and team statistics as flat rows."""
    return flatten_records(read_table(spark, folder, "matches"), read_table(spark, folder, "worldcup"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What each snapshot added, removed or changed."""
    return snapshot_changes(
        {
            "match_polls": (read_table(spark, folder, "match_polls"), False, ("status", "score_home", "score_away")),
            "event_polls": (read_table(spark, folder, "event_polls"), True, ("minute", "type", "detail")),
        }
    )


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}

_REFS = " union all ".join(
    f"select '{t}' as tab, '{c}' as col, source, {c} as ref_value, collected_at from {t}"
    for t, c in (("matches", "home_entity"), ("entities", "parent_entity"), ("football_stats", "match_id"), ("football_lineups", "match_id"))
)

_P5 = """
select '{tab}' as tab, source, cast(snapshot_no as int) as snapshot_no, match_id, cast(seq as int) as seq, change from (
  with latest as (select source, snapshot_no, match_id, {seq} as seq, {values} from {tab}
      qualify row_number() over (partition by source, snapshot_no, match_id, {seq} order by polled_at desc) = 1),
    slates as (select source, snapshot_no, lag(snapshot_no) over (partition by source order by snapshot_no) as prev,
        lead(snapshot_no) over (partition by source order by snapshot_no) as next from (select distinct source, snapshot_no from {tab})),
    placed as (select l.*, s.prev, s.next from latest l join slates s using (source, snapshot_no))
  select b.source, b.snapshot_no, b.match_id, b.seq, case when a.source is null then 'added' else 'changed' end as change
  from placed b left join placed a on a.source = b.source and a.snapshot_no = b.prev and a.match_id = b.match_id and a.seq = b.seq
  where b.prev is not null and (a.source is null or {differ})
  union all
  select a.source, a.next, a.match_id, a.seq, 'removed' from placed a
  where a.next is not null and not exists (select 1 from latest b where b.source = a.source and b.snapshot_no = a.next and b.match_id = a.match_id and b.seq = a.seq)
)"""


def _p5(tab: str, seq: str, values: tuple[str, ...]) -> str:
    return _P5.format(tab=tab, seq=seq, values=", ".join(values), differ=" or ".join(f"a.{v} is distinct from b.{v}" for v in values))


_P3 = """
with raw as (
  select 'matches' as tab, match_id as rec_key, source, kickoff_utc as k,
    coalesce(case when json_valid(payload) then coalesce(json_extract_string(payload, '$.venue_tz'),
      case when json_type(payload) = 'VARCHAR' and json_valid(json_extract_string(payload, '$')) then json_extract_string(json_extract_string(payload, '$'), '$.venue_tz') end) end, 'UTC') as tz
  from matches
  union all
  select 'worldcup', cast(wc_id as varchar), '', "date" || ' ' || "time", null from worldcup
), clean as (
  select tab, rec_key, source, tz, trim(regexp_replace(replace(k, '−', '-'), '\\s+', ' ', 'g')) as k from raw
), parts as (
  select *, regexp_extract(k, '^((?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? )?(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{8}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,2} [A-Za-z]+ [0-9]{4}|[A-Za-z]+ [0-9]{1,2}, [0-9]{4}))(?:T|,? )([0-9].*)$', ['d', 't']) as p
  from clean
), fields as (
  select tab, rec_key, source, tz, k, regexp_replace(p.d, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ', '') as d,
    case when regexp_matches(p.t, '^[0-9]{6}([+-].*)?$') then regexp_replace(p.t, '^(..)(..)(..)', '\\1:\\2:\\3') else p.t end as t
  from parts
), timed as (
  select *, regexp_extract(t, '^([0-9]{1,2})[:.h]([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)? *(?:([aApP])[.]?[mM][.]?(?: +|$))?([^\\[]*)(?:\\[(.*)\\])?$', ['h', 'mi', 's', 'half', 'zone', 'region']) as f,
    coalesce(case when regexp_matches(d, '^[0-9]+/[0-9]+/[0-9]{4}$') then case when source = 'stadia9' then try_strptime(d, '%m/%d/%Y') else try_strptime(d, '%d/%m/%Y') end end,
      try_strptime(d, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%d.%m.%Y', '%d %b %Y', '%d %B %Y', '%B %d, %Y', '%b %d, %Y'])) as day
  from fields
), local as (
  select tab, rec_key, k, tz, upper(trim(f.zone)) as zone, trim(f.zone) as name, f.region as region,
    day + to_seconds(cast((case when f.half = '' then try_cast(f.h as int) when lower(f.half) = 'p' then try_cast(f.h as int) % 12 + 12 else try_cast(f.h as int) % 12 end) * 3600
      + try_cast(f.mi as int) * 60 + case when f.s = '' then 0 else try_cast(f.s as int) end as bigint)) as loc
  from timed where day is not null and f.h <> ''
), zoned as (
  select *, regexp_extract(zone, '^(?:UTC|GMT)?([+-])([0-9]{1,2}):?([0-9]{2})?$', ['sign', 'h', 'm']) as o,
    map {'Z': 0, 'UTC': 0, 'GMT': 0, 'WET': 0, 'WEST': 60, 'BST': 60, 'CET': 60, 'CEST': 120, 'EET': 120, 'EEST': 180, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420, 'JST': 540} as known
  from local
), resolved as (
  select tab, rec_key, loc, case when o.h <> '' then (case when o.sign = '-' then -1 else 1 end) * (try_cast(o.h as int) * 60 + case when o.m = '' then 0 else try_cast(o.m as int) end)
      when known[zone] is not null then known[zone] end as minutes,
    case when zone = '' then tz else name end as region
  from zoned
), instants as (
  select tab, rec_key, case when minutes is not null then loc - to_minutes(minutes)
    when region is not null then cast(case when timezone(region, timezone(region, loc) - interval 1 hour) = loc then timezone(region, loc) - interval 1 hour else timezone(region, loc) end at time zone 'UTC' as timestamp) end as instant
  from resolved
  union all
  select tab, rec_key, make_timestamp((case when length(k) > 11 then try_cast(k as bigint) // 1000 else try_cast(k as bigint) end) * 1000000) from clean where regexp_matches(k, '^[0-9]{9,14}$')
)
select distinct tab, rec_key, strftime(instant, '%Y-%m-%dT%H:%M:%SZ') as instant_utc from instants where instant is not null
"""

_P4 = """
with texts as (
  select distinct match_id as rec_key, case when json_type(payload) = 'VARCHAR' then json_extract_string(payload, '$') else payload end as p
  from matches where json_valid(payload)
), docs as (select rec_key, cast(p as json) as p from texts where json_valid(p)),
found as (
  select rec_key, coalesce(nullif(p -> '$.lineups', 'null'), p -> '$.rosters') as l, coalesce(nullif(p -> '$.stats', 'null'), p -> '$.boxscore.teams') as s from docs
), lists as (
  select rec_key,
    case json_type(l) when 'ARRAY' then cast(l as json[]) when 'OBJECT' then case when json_exists(l, '$.home') or json_exists(l, '$.away') then [l -> '$.home', l -> '$.away'] else [l] end end as l,
    case json_type(s) when 'ARRAY' then cast(s as json[]) when 'OBJECT' then case when json_exists(s, '$.home') or json_exists(s, '$.away') then [s -> '$.home', s -> '$.away'] else [s] end end as s
  from found
), lineups as (select rec_key, unnest(l) as e, generate_subscripts(l, 1) - 1 as i from lists),
members as (
  select rec_key, i, coalesce(nullif(e -> '$.players', 'null'), e -> '$.roster') as m from lineups where e is not null and json_type(e) = 'OBJECT'
), listed as (
  select rec_key, i, case json_type(m) when 'ARRAY' then cast(m as json[]) when 'OBJECT' then [m] end as m from members
), players as (select rec_key, i, unnest(m) as e, generate_subscripts(m, 1) - 1 as j from listed),
teams as (select rec_key, unnest(s) as e, generate_subscripts(s, 1) - 1 as i from lists)
select 'matches' as tab, rec_key, 'players' as arr, cast(i as int) as i, cast(j as int) as j,
  coalesce(e ->> '$.display_name', e ->> '$.athlete.displayName', '') as val_a, coalesce(e ->> '$.athlete_id', e ->> '$.athlete.id', '') as val_b
from players where e is not null and json_type(e) <> 'NULL'
union
select 'matches', rec_key, 'stats', cast(i as int), -1, coalesce(case when json_type(e, '$.team') = 'VARCHAR' then e ->> '$.team' end, e ->> '$.team.displayName', ''), ''
from teams where e is not null and json_type(e) <> 'NULL'
union
select 'worldcup', cast(wc_id as varchar), arr, cast(i as int), -1, coalesce(g.name, ''), coalesce(g.minute, '') from (
  select wc_id, 'goals1' as arr, unnest(goals1) as g, generate_subscripts(goals1, 1) - 1 as i from worldcup
  union all select wc_id, 'goals2', unnest(goals2), generate_subscripts(goals2, 1) - 1 from worldcup) where g is not null
"""

ORACLES = {
    "p2_found": f"""
with refs as (select * from ({_REFS}) where regexp_matches(ref_value, '\\S')),
lost as (select * from refs r where case when col = 'match_id'
  then not exists (select 1 from matches m where m.match_id = r.ref_value and m.deleted_at is null)
  else not exists (select 1 from entities e where e.source = r.source and e.entity_id = r.ref_value and e.deleted_at is null) end)
select tab, col, source, ref_value, strftime(min(collected_at), '%Y-%m') as period from lost group by tab, col, source, ref_value""",
    "p3_found": _P3,
    "p4_found": _P4,
    "p5_found": _p5("match_polls", "-1", ("status", "score_home", "score_away")) + " union all " + _p5("event_polls", "seq", ("minute", "type", "detail")),
}
