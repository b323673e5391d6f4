"""Queries of reconciliation over whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import feed as V
from matchloom.operators import reconcile as C
from matchloom.plans.readport import _KEY
from matchloom.plans.records import _M, _matches
from matchloom.sources import read_table


def _side(name):
    return F.get_json_object("payload", f"$.{name}_team").alias(f"{name}_team")


def _rows(s, d, source, key):
    """A provider's matches as rows of the one source x."""
    m = _matches(s, d).where((F.col("source") == source) & F.col("match_id").isNotNull())
    return m.select(F.lit("x").alias("source"), F.col("match_id").alias(key), F.when(F.col("kickoff_utc").endswith("Z"), F.col("kickoff_utc")).alias("kickoff_utc"), _side("home"), _side("away"), "score_home", "score_away", "payload")


def _schedule(s, d):
    return _rows(s, d, "terrafeed", "match_id").drop("score_home", "score_away")


def fixtures_in_window(s, d):
    """The schedule's match nearest in time to each of pitchwire's, of the same two names."""
    return C.in_window(_rows(s, d, "pitchwire", "provider_id"), _schedule(s, d)).select("provider_id", "window_id", F.col("apart").cast("bigint").alias("apart"))


def ids_resolved(s, d):
    """Pitchwire's matches against a map, their own ids, the schedule and their stubs, each of which knows a part of them."""
    provider = _rows(s, d, "pitchwire", "provider_id")
    nth = F.length("provider_id") + F.ascii(F.substring("provider_id", -1, 1))
    entries = provider.where(nth % 5 == 0).select("source", "provider_id", F.concat(F.lit("m"), "provider_id").alias("match_id"))
    known = provider.where(nth % 5 == 1).withColumn("match_id", F.col("provider_id")).unionByName(provider.where(nth % 2 == 0).withColumn("match_id", V.qualified_id(F.col("source"), F.col("provider_id"))))
    stored = _schedule(s, d).unionByName(known.select(*_schedule(s, d).columns))
    return C.resolved(provider, entries, stored).select("provider_id", "match_id", "how")


def stub_rows(s, d):
    """Kikt's matches written where nothing is stored."""
    rows = C.write_view(_rows(s, d, "kikt", "provider_id"), s.createDataFrame([], "source string, provider_id string, match_id string"), _schedule(s, d).limit(0))
    return rows.select("provider_id", "match_id", "how", "home_team", "away_team", "score_home", "score_away")


def sides_turned(s, d):
    """Payloads with their sides exchanged where the away side won."""
    m = _matches(s, d)
    turned = m.withColumn("payload", C.turn_payload(F.when(F.col("score_away") > F.col("score_home"), F.col("payload")))).where("payload is not null and try_parse_json(payload) is not null")
    return turned.select("source", "match_id", *[F.get_json_object("payload", f"$.score_ht_{n}").alias(f"ht_{n}") for n in ("home", "away")])


def sides_reversed(s, d):
    """How many of the matches in the window have their sides the other way round."""
    provider = C.with_keys(_rows(s, d, "pitchwire", "provider_id"))
    near = C.in_window(_rows(s, d, "pitchwire", "provider_id"), _schedule(s, d))
    stored = C.with_keys(_schedule(s, d)).select(F.col("match_id").alias("window_id"), F.col("home_key").alias("sh"), F.col("away_key").alias("sa"))
    both = near.join(provider.drop("source"), "provider_id").join(stored, "window_id")
    return both.select(C.reversed_sides(F.col("home_key"), F.col("away_key"), F.col("sh"), F.col("sa")).alias("turned")).groupBy("turned").agg(F.count("*").alias("n"))


def named_matches(s, d):
    """Names of both sides, told by the payload or by the entities."""
    m = _matches(s, d).where("match_id is not null").select("source", "match_id", "home_entity", "away_entity", _side("home"), _side("away"))
    return C.named_by_entities(m, read_table(s, d, "entities")).select("source", "match_id", "home_team", "away_team")


def stored_forms(s, d):
    """Each provider id's stored match, by qualified or bare id."""
    m = _matches(s, d, "status").where("match_id is not null").select("source", "match_id", "updated_at")
    asked = m.select("source", V.provider_id(F.col("source"), F.col("match_id")).alias("provider_id")).distinct()
    entries = s.createDataFrame([], "source string, provider_id string, match_id string")
    return C.stored_row(m, entries, asked).withColumn("rank", F.col("rank").cast("bigint"))


def work_order(s, d):
    ids = read_table(s, d, "match_polls").select("source", "match_id").distinct()
    return C.in_order(ids, "match_id").withColumn("turn", F.col("turn").cast("bigint"))


_NAMES = "fixtures_in_window ids_resolved stub_rows sides_turned sides_reversed named_matches stored_forms work_order".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_AT = "try_strptime(kickoff_utc, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%MZ'])"
_OF = lambda source: f"""(select match_id, h, a, {_KEY('h')} as hk, {_KEY('a')} as ak, {_AT} as t, kickoff_utc, score_home, score_away from (select *, case when json_valid(payload) then payload ->> '$.home_team' end as h, case when json_valid(payload) then payload ->> '$.away_team' end as a from {_M}) where source = '{source}' and match_id is not null)"""
_NEAR = f"""select p.match_id as provider_id, s.match_id as window_id, abs(date_diff('second', p.t, s.t)) as apart, p.hk, p.ak, s.hk as sh, s.ak as sa from {_OF('pitchwire')} p join {_OF('terrafeed')} s
on p.hk <> '' and p.ak <> '' and s.hk <> '' and s.ak <> '' and least(p.hk, p.ak) = least(s.hk, s.ak) and greatest(p.hk, p.ak) = greatest(s.hk, s.ak) and abs(date_diff('second', p.t, s.t)) <= 10800 and not contains(s.match_id, ':')
qualify row_number() over (partition by p.match_id order by abs(date_diff('second', p.t, s.t)), s.match_id) = 1"""
_PROVIDER = "case when starts_with(match_id, source || ':') then substr(match_id, length(source) + 2) else match_id end"
ORACLES = {
    "fixtures_in_window": f"select provider_id, window_id, apart from ({_NEAR})",
    "ids_resolved": f"""with w as ({_NEAR}), p as (select match_id as id, length(match_id) + ascii(right(match_id, 1)) as nth from {_OF('pitchwire')})
select id as provider_id, case when nth % 5 = 0 then 'm' || id when nth % 5 = 1 then id when window_id is not null then window_id when nth % 2 = 0 then 'x:' || id end as match_id,
case when nth % 5 = 0 then 'map' when nth % 5 = 1 then 'direct' when window_id is not null then 'window' when nth % 2 = 0 then 'stub' end as how from p left join w on w.provider_id = p.id""",
    "stub_rows": f"""select match_id as provider_id, case when ok then 'x:' || match_id end as match_id, case when ok then 'new' end as how, h as home_team, a as away_team, score_home, score_away
from (select *, coalesce(h <> '' and a <> '' and kickoff_utc like '%Z', false) as ok from {_OF('kikt')})""",
    "sides_turned": f"select source, match_id, payload ->> '$.score_ht_away' as ht_home, payload ->> '$.score_ht_home' as ht_away from {_M} where score_away > score_home and json_valid(payload)",
    "sides_reversed": f"select sh <> sa and hk = sa and ak = sh as turned, count(*) as n from ({_NEAR}) group by 1",
    "named_matches": f"""with e as (select source, entity_id, min(display_name) as name from entities group by 1, 2), m as (select *, case when json_valid(payload) then payload end as p from {_M} where match_id is not null)
select m.source, m.match_id, coalesce(nullif(p ->> '$.home_team', ''), h.name) as home_team, coalesce(nullif(p ->> '$.away_team', ''), a.name) as away_team from m
left join e h on h.source = m.source and h.entity_id = m.home_entity left join e a on a.source = m.source and a.entity_id = m.away_entity""",
    "stored_forms": f"""with m as (select source, match_id, {_PROVIDER} as provider_id, starts_with(match_id, source || ':') as stub, updated_at from {_M} where match_id is not null)
select source, provider_id, match_id, cast(case when stub then 1 else 2 end as bigint) as rank from m qualify row_number() over (partition by source, provider_id order by case when stub then 1 else 2 end, updated_at desc nulls last, match_id) = 1""",
    "work_order": "select source, match_id, row_number() over (partition by source order by match_id) as turn from (select distinct source, match_id from match_polls)",
}
