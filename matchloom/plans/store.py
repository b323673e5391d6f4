"""Queries of what writers of a store may do, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import feed as V
from matchloom.operators import store as W
from matchloom.plans.records import _FOLD, _E, _events
from matchloom.sources import read_table


def write_guard(s, d):
    """What a writer of kikt may not write of the line-ups."""
    known = read_table(s, d, "matches").where("match_id is not null").select("match_id", "source")
    rows = W.ownership(W.stamped(read_table(s, d, "football_lineups").select("match_id").where("match_id is not null"), "kikt"), known, "kikt")
    return rows.groupBy("fault").agg(F.count("*").alias("n"))


_TYPES = ("goal", "own_goal", "yellow", "red", "sub", "kickoff", "half_time", "full_time")


def append_batches(s, d):
    """All events of every match sent again, in order of their minutes, to a store that has their first three; penalties are not declared."""
    e = _events(s, d)
    known = read_table(s, d, "event_polls").groupBy("match_id").agg(F.min("source").alias("source"))
    batch = e.withColumn("arrival", F.coalesce("minute", F.lit(0)) * 1000 + F.col("seq"))
    return W.append_events(e.where("seq < 3"), batch, known, "arrival", _TYPES).select("source", "match_id", "seq", "drift", "fault", "refused")


def entity_batches(s, d):
    """How many rows of each source's entities may not be written, and why."""
    judged = W.entity_faults(read_table(s, d, "entities"))
    return judged.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("fault") == "incomplete").alias("incomplete"), F.count_if(F.col("fault") == "stale").alias("stale"))


def entity_upserts(s, d):
    rows = read_table(s, d, "entities").withColumn("v", F.struct("collected_at", "display_name", F.coalesce("payload", F.lit(""))))
    return W.upsert_entities(rows.select("source", "entity_id", "kind", "display_name", "name_folded", "v"), "v").select("source", "entity_id", "kind", "display_name", F.md5("name_folded").alias("fold"))


def standing_upserts(s, d):
    """Orders as changes of standings: every other order gives points only, the rest the rank only."""
    o = read_table(s, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    log = o.select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("group_key"), F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_totalprice").alias("points"),
        F.dayofyear("o_orderdate").alias("rank"), F.when(even, F.array(F.lit("points"))).otherwise(F.array(F.lit("rank"))).alias("provided"), F.struct("o_orderdate", "o_orderkey").alias("v"),
    )
    return W.upsert_standings(log, "v")


def _map_log(s, d):
    m = read_table(s, d, "matches").where("match_id is not null and home_entity is not null")
    version = F.struct(F.coalesce("updated_at", F.lit("")), "collected_at", "match_id")
    return m.select("source", F.col("source").alias("provider"), F.col("home_entity").alias("provider_match_id"), "match_id", F.col("deleted_at").isNotNull().alias("deleted"), version.alias("v"))


def map_entries(s, d):
    """Provider ids (here home sides) with the match they last led to, deleted ones left out."""
    return W.provider_map(_map_log(s, d), "v")


def map_reverse(s, d):
    """Per match the first of its provider ids and whether there are several."""
    both = _map_log(s, d).select("source", "provider", "provider_match_id", "match_id").unionByName(
        read_table(s, d, "matches").where("match_id is not null and away_entity is not null").select("source", F.col("source").alias("provider"), F.col("away_entity").alias("provider_match_id"), "match_id")
    )
    return W.reverse_map(both).drop("ids")


_STATS = ("possession", "shots", "shots_on_target", "corners", "fouls", "yellow_cards", "red_cards", "offsides")


def _stats(s, d, pick):
    """Each team's row of a match that was collected first or last."""
    rows = read_table(s, d, "football_stats").where("source is not null and match_id is not null and team is not null")
    return rows.groupBy("source", "match_id", "team").agg(pick(F.struct("collected_at", *_STATS)).alias("r")).select("source", "match_id", "team", *[f"r.{c}" for c in _STATS])


def _corrected(s, d):
    """Statistics collected last, sides with much of the ball one corner more."""
    return _stats(s, d, F.max).withColumn("corners", F.col("corners") + F.coalesce(F.col("possession") > 60, F.lit(False)).cast("int"))


def stat_slices(s, d):
    """Matches whose statistics are others when corrected than when collected first."""
    return W.changed_slices(_stats(s, d, F.min), _corrected(s, d), ["source", "match_id"])


def stat_replaced(s, d):
    """Statistics after the changed matches were replaced."""
    return W.replace_if_changed(_stats(s, d, F.min), _corrected(s, d), ["source", "match_id"])


def roster_inserts(s, d):
    """First names under each number of the line-ups' teams that were never offside often."""
    rows = read_table(s, d, "football_lineups").where("team is not null and jersey is not null and display_name is not null").select("team", F.col("jersey").alias("number"), "display_name", F.struct("collected_at", "display_name").alias("o"))
    return W.insert_once(read_table(s, d, "football_stats").where("offsides >= 6").select("team"), rows, "team", "number", "o").drop("o")


def _adoption(s, d):
    """Qualified ids and what they are without their source."""
    rows = read_table(s, d, "matches").where("match_id is not null").select("source", F.col("match_id").alias("stub_id")).distinct()
    return rows.withColumn("canonical_id", V.provider_id(F.col("source"), F.col("stub_id"))).where("canonical_id <> stub_id")


def adopted_stats(s, d):
    """Statistics with stubs' ids made canonical, those of the canonical match (here the ones collected first) giving way."""
    own = _stats(s, d, F.max)
    early = _stats(s, d, F.min).withColumn("match_id", V.provider_id(F.col("source"), F.col("match_id")))
    both = own.unionByName(early.join(own.select("source", "match_id").distinct(), ["source", "match_id"], "left_anti"))
    return W.rekey(both, _adoption(s, d), ["source", "match_id", "team"])


def adoption_refused(s, d):
    """Stubs by source and whether they may be adopted: not where the canonical match, here every second one, has events too."""
    e = read_table(s, d, "event_polls").select("source", "match_id")
    canonical = e.withColumn("match_id", V.provider_id(F.col("source"), F.col("match_id"))).where("length(match_id) % 2 = 0")
    return W.adoptable(_adoption(s, d), e.unionByName(canonical)).groupBy("source", "refused").agg(F.count("*").alias("n"))


_NAMES = "write_guard append_batches entity_batches entity_upserts standing_upserts map_entries map_reverse stat_slices stat_replaced roster_inserts adopted_stats adoption_refused".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_PID = "case when starts_with({m}, source || ':') then substr({m}, length(source) + 2) else {m} end"
_ROWS = "(select * from football_stats where source is not null and match_id is not null and team is not null)"
_VALUES = ", ".join(_STATS)
_PICK = lambda end, nulls: f"(select source, match_id, team, {_VALUES} from {_ROWS} qualify row_number() over (partition by source, match_id, team order by collected_at {end}, {', '.join(f'{c} {end} nulls {nulls}' for c in _STATS)}) = 1)"
# A struct's null is its least value.
_FIRST, _LAST = _PICK("asc", "first"), _PICK("desc", "last")
_RIGHT = f"(select * replace (corners + case when possession > 60 then 1 else 0 end as corners) from {_LAST})"
_SLICES = f"select distinct source, match_id from ((select * from {_FIRST} except all select * from {_RIGHT}) union all (select * from {_RIGHT} except all select * from {_FIRST}))"
_STUBS = f"(select *, {_PID.format(m='stub_id')} as canonical_id from (select distinct source, match_id as stub_id from matches where match_id is not null) where starts_with(stub_id, source || ':'))"
ORACLES = {
    "write_guard": "with o as (select match_id, min(source) as owner from matches where match_id is not null group by 1) select case when owner is null then 'unseeded' when owner <> 'kikt' then 'cross_partition' end as fault, count(*) as n from football_lineups l left join o using (match_id) where l.match_id is not null group by 1",
    "append_batches": f"""with b as (select *, coalesce(minute, 0) * 1000 + seq as arrival from {_E}), o as (select match_id, min(source) as owner from event_polls group by 1), h as (select source, match_id, max(seq) as head from b where seq < 3 group by 1, 2),
k as (select b.*, o.owner, h.head, lag(seq) over (partition by b.source, b.match_id order by arrival) as before from b left join o using (match_id) left join h using (source, match_id)),
f as (select source, match_id, seq, case when seq < 3 then 'resend' when seq <= head then 'retroactive' else 'new' end as drift,
case when owner <> source then 'cross_partition' when not coalesce(type in ('goal', 'own_goal', 'yellow', 'red', 'sub', 'kickoff', 'half_time', 'full_time'), false) then 'undeclared' when seq <= before then 'not_increasing' when seq >= 3 and seq <= head then 'retroactive' end as fault from k)
select *, bool_or(fault is not null) over (partition by source, match_id) as refused from f""",
    "entity_batches": f"select source, count(*) as n, count(*) filter (where kind is null or display_name is null) as incomplete, count(*) filter (where kind is not null and display_name is not null and name_folded <> {_FOLD}) as stale from entities group by 1",
    "entity_upserts": f"select source, entity_id, kind, display_name, md5({_FOLD}) as fold from entities where kind is not null and display_name is not null qualify row_number() over (partition by source, entity_id order by collected_at desc, display_name desc, coalesce(payload, '') desc) = 1",
    "standing_upserts": """with k as (select o_orderpriority as source, o_orderstatus as group_key, cast(o_custkey as varchar) as entity_id, * from orders)
select source, group_key, entity_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) filter (where o_orderkey % 2 = 0) as points, cast(arg_max(dayofyear(o_orderdate), (o_orderdate, o_orderkey)) filter (where o_orderkey % 2 = 1) as int) as rank from k group by 1, 2, 3""",
    "map_entries": """with l as (select source, source as provider, home_entity as provider_match_id, match_id, deleted_at from matches where match_id is not null and home_entity is not null
qualify row_number() over (partition by source, home_entity order by coalesce(updated_at, '') desc, collected_at desc, match_id desc, deleted_at is not null desc) = 1) select source, provider, provider_match_id, match_id from l where deleted_at is null""",
    "map_reverse": "select source, match_id, min(id) as first, count(distinct id) > 1 as several from (select source, match_id, home_entity as id from matches where match_id is not null and home_entity is not null union all select source, match_id, away_entity from matches where match_id is not null and away_entity is not null) group by 1, 2",
    "stat_slices": _SLICES,
    "stat_replaced": f"with c as ({_SLICES}) select * from {_FIRST} f where not exists (select 1 from c where c.source = f.source and c.match_id = f.match_id) union all select * from {_RIGHT} l where exists (select 1 from c where c.source = l.source and c.match_id = l.match_id)",
    "roster_inserts": "select team, jersey as number, display_name from football_lineups where team is not null and jersey is not null and display_name is not null and team not in (select team from football_stats where team is not null and offsides >= 6) qualify row_number() over (partition by team, jersey order by collected_at, display_name) = 1",
    "adopted_stats": f"""with own as {_LAST}, early as (select * replace ({_PID.format(m='match_id')} as match_id) from {_FIRST}), every as (select * from own union all select * from early e where not exists (select 1 from own o where o.source = e.source and o.match_id = e.match_id)),
m as (select b.*, a.canonical_id from every b left join {_STUBS} a on a.source = b.source and a.stub_id = b.match_id)
select source, coalesce(canonical_id, match_id) as match_id, team, {_VALUES} from m qualify row_number() over (partition by source, coalesce(canonical_id, match_id), team order by canonical_id is not null desc) = 1""",
    "adoption_refused": f"""with e as (select source, match_id from event_polls), x as (select * from e union all select source, m from (select source, {_PID.format(m='match_id')} as m from e) where length(m) % 2 = 0)
select source, exists (select 1 from x where x.source = a.source and x.match_id = a.stub_id) and exists (select 1 from x where x.source = a.source and x.match_id = a.canonical_id) as refused, count(*) as n from {_STUBS} a group by 1, 2""",
}
