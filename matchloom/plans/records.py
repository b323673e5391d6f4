"""Queries of the record operators with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions.feed import TAXONOMY
from matchloom.operators import changes, merges, readport, reads
from matchloom.sources import read_table

def _matches(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The last delivery of every match; of the columns only ``names`` are read and shuffled, if any are given."""
    rows = read_table(spark, folder, "matches").drop("deleted_at")
    keys, order = ["source", "match_id"], ["updated_at", "collected_at"]
    return reads.current_rows(rows.select(*keys, *order, *names) if names else rows, keys, order)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return changes.record_union(read_table(spark, folder, "event_polls"))


def _event_types(spark: SparkSession, folder: str) -> DataFrame:
    """The last copy of every event, without what it tells beyond its type."""
    return changes.record_union(read_table(spark, folder, "event_polls").select("source", "match_id", "seq", "snapshot_no", "polled_at", "minute", "period", "type"))


#: The same two inputs in SQL.
_M = "(select source, match_id, kickoff_utc, home_entity, away_entity, status, minute, period, score_home, score_away, display_clock, payload, updated_at from matches qualify row_number() over (partition by source, match_id order by updated_at desc, collected_at desc) = 1)"
_E = "(select source, match_id, seq, minute, period, type, importance, actor_entity, target_entity, detail, payload from event_polls qualify row_number() over (partition by source, match_id, seq order by snapshot_no desc, polled_at desc, minute desc nulls last, period desc nulls last, type desc, importance desc, actor_entity desc nulls last, target_entity desc nulls last, detail desc nulls last, payload desc) = 1)"


def latest_state(s, d):
    return reads.latest_state(_matches(s, d, "status"), _event_types(s, d))


def list_matches(s, d):
    return reads.list_matches(_matches(s, d, "kickoff_utc", "status", "score_home", "score_away"), status="FINISHED").drop("updated_at", "collected_at")


def events_since(s, d):
    return reads.events_since(_event_types(s, d), since_seq=3).select("source", "match_id", "seq", "type", "minute")


def latest_of_type(s, d):
    return reads.latest_of_type(_event_types(s, d), reads.MARKERS)


def has_any_event(s, d):
    return reads.has_any_event(_matches(s, d, "status"), read_table(s, d, "event_polls")).select("source", "match_id")


def finished_without_events(s, d):
    return reads.ended_without_events(_matches(s, d, "status"), read_table(s, d, "event_polls")).groupBy("source").agg(F.count("*").alias("n"))


def find_by_name(s, d):
    return reads.find_by_name(read_table(s, d, "entities"), F.col("display_name")).select("source", "entity_id", "kind").distinct()


def fold_names(s, d):
    return read_table(s, d, "entities").select("source", "entity_id", F.md5(T.fold("display_name")).alias("fold")).distinct()


def stale_folds(s, d):
    e = read_table(s, d, "entities").select("source", "kind", T.fold("display_name").alias("fold"), "name_folded")
    return e.groupBy("source", "kind").agg(F.count_if(~F.col("fold").eqNullSafe(F.col("name_folded"))).alias("stale"), F.count("*").alias("n"))


def squad_order(s, d):
    rows = read_table(s, d, "football_lineups").select("source", "match_id", "team", "athlete_id", "formation_place").distinct()
    return reads.squad(rows).select("source", "match_id", "team", "athlete_id", F.col("place").cast("bigint").alias("place"))


def player_stats(s, d):
    rows = read_table(s, d, "football_stats").drop("collected_at").distinct()
    return readport.with_source(rows, read_table(s, d, "matches")).select("source", "match_id", "team", "possession", "shots", "corners")


def lineup_announced(s, d):
    return reads.announced(read_table(s, d, "football_lineups"))


def match_participants(s, d):
    p = reads.participants(_matches(s, d)).select("source", "match_id", F.explode("participants").alias("p"))
    return p.select("source", "match_id", "p.name", "p.side", "p.score")


def event_view(s, d):
    return reads.event_view(_events(s, d))


def card_counts(s, d):
    return reads.card_counts(_events(s, d))


def snapshot_diff(s, d):
    return changes.diff_polls(read_table(s, d, "match_polls"), read_table(s, d, "event_polls"))


def event_diff(s, d):
    return changes.event_diff(read_table(s, d, "event_polls"))


def drift_classify(s, d):
    return changes.poll_drift(read_table(s, d, "event_polls"))


def drift_news(s, d):
    return changes.drift_news(changes.poll_drift(read_table(s, d, "event_polls"))).where("first").drop("first")


def replay_reveal(s, d):
    revealed = changes.replay(_events(s, d), elapsed_s=40.0, speed=60.0)
    return revealed.groupBy("source", "match_id").agg(F.count("*").alias("n"), F.max("seq").alias("head"))


def step_reveal(s, d):
    return changes.step(_events(s, d), 3).select("source", "match_id", "seq", "type")


def record_union(s, d):
    return _events(s, d).select("source", "match_id", "seq", "type", "minute", "detail")


def taxonomy_gate(s, d):
    """Types of both event tables that are not declared, and how often they occur."""
    rows = read_table(s, d, "event_polls").select("type").unionByName(read_table(s, d, "events").select(F.col("event_type").alias("type")))
    return changes.outside_taxonomy(rows, tuple(TAXONOMY)).groupBy("type").agg(F.count("*").alias("n"))


def seq_stats(s, d):
    return reads.seq_stats(read_table(s, d, "event_polls").select("source", "match_id", "seq").distinct())


def upsert_last_wins(s, d):
    rows = read_table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    return reads.current_rows(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def masked_upsert(s, d):
    polls = read_table(s, d, "match_polls")
    rows = changes.one_per_poll(polls, ["source", "match_id"])
    odd = F.col("snapshot_no") % 2 == 1
    log = rows.withColumn("provided", F.when(odd, F.array(F.lit("status"), F.lit("score_home"))).otherwise(F.array(F.lit("minute"), F.lit("score_home"))))
    return merges.masked_upsert(log, ["source", "match_id"], "snapshot_no", ["status", "minute", "score_home"])


def accrued_state(s, d):
    rows = changes.one_per_poll(read_table(s, d, "match_polls"), ["source", "match_id"])
    sides = {n: F.get_json_object("payload", f"$.{n}") for n in ("home_team", "away_team")}
    return merges.accrue(rows.withColumns(sides).drop("payload"), ["source", "match_id"], "snapshot_no", tuple(sides))


def payload_merge(s, d):
    pairs = _poll_pairs(s, d, "payload")
    return pairs.select("snapshot_no", "source", "match_id", merges.merge_payload(F.col("old.payload"), F.col("now.payload")).alias("payload"))


def captured_states(s, d):
    """What each row says of the one before it: worth keeping, disproved by this one, live no more, over at first sight."""
    polls = changes.one_per_poll(read_table(s, d, "match_polls"), ["source", "match_id"])
    state = F.struct(*merges.SCALARS)
    rows = polls.select("snapshot_no", "source", "match_id", state.alias("now"), F.lag(state).over(Window.partitionBy("source", "match_id").orderBy("snapshot_no")).alias("old"))
    now, old = F.col("now"), F.col("old")
    flags = {"kept": merges.worth_retaining(old), "disproved": merges.supersedes(now, old), "off": merges.went_off(old, now), "late": merges.first_sight_finished(now, old, F.lit(None))}
    return rows.select("snapshot_no", "source", "match_id", *[F.when(old.isNotNull() | F.lit(n == "late"), c).alias(n) for n, c in flags.items()])


def closing_state(s, d):
    """Each row of a match closed over its first, its previous and the one before that."""
    polls = changes.one_per_poll(read_table(s, d, "match_polls"), ["source", "match_id"])
    state, order = F.struct(*merges.SCALARS), Window.partitionBy("source", "match_id").orderBy("snapshot_no")
    rows = polls.select(
        "snapshot_no", "source", "match_id", state.alias("fresh"), F.lag(state).over(order).alias("baseline"), F.lag(state, 2).over(order).alias("fallback"),
        F.first(state).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stored"),
    )
    return rows.select("snapshot_no", "source", "match_id", *[c.alias(n) for n, c in merges.give_up().items()])


def _poll_pairs(s, d, *fields):
    """Each match's row in a snapshot (now) and in its source's previous one (old)."""
    return changes.step_pairs(read_table(s, d, "match_polls"), ["source", "match_id"], lambda df: F.struct(*fields), "inner")


def merge_detail(s, d):
    kickoff = F.get_json_object("payload", "$.kickoff_utc").alias("kickoff_utc")
    merged = merges.merge_detail(F.col("now"), F.col("old"))
    return _poll_pairs(s, d, *merges.SCALARS, kickoff).select("snapshot_no", "source", "match_id", *[c.alias(n) for n, c in merged.items()])


def not_regressing(s, d):
    """Each row over the later one, with and without forcing an end."""
    pairs = _poll_pairs(s, d, *merges.SCALARS)
    both = [merges.not_regressing(F.col("now"), F.col("old"), force_terminal=forced) for forced in (False, True)]
    names = [(n, f"{n}{end}") for n in merges.SCALARS for end in ("", "_forced")]
    return pairs.select("snapshot_no", "source", "match_id", *[both[new.endswith("_forced")][n].alias(new) for n, new in names])


def flip_orientation(s, d):
    rows = _matches(s, d, "home_entity", "away_entity", "score_home", "score_away").drop("updated_at", "collected_at")
    return merges.flip(rows, F.coalesce(F.col("score_away") > F.col("score_home"), F.lit(False)))


def window_nearest(s, d):
    e = read_table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("id"))
    right = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("rid"))
    return merges.nearest_in_window(left, right, ["user_id"], "ts", 180).select("id", "rid")


def resolve_authority(s, d):
    rows = read_table(s, d, "matches").where("match_id is not null").select("source", "match_id", "updated_at", "home_entity")
    arms = rows.withColumn("rank", F.when(F.col("match_id").contains(":"), 1).when(F.col("match_id").contains("_vs_"), 0).otherwise(2))
    return merges.authority(arms.where("home_entity is not null").select("home_entity", "match_id", "updated_at", "rank").distinct(), "home_entity").select("home_entity", "match_id", F.col("rank").cast("bigint").alias("rank"))


def feed_texts(s, d):
    goals = read_table(s, d, "worldcup").select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("goals1", "goals2")])).alias("g")).select("g.minute")
    return goals.where("minute is not null").select("minute", T.minute_of(F.col("minute")).alias("parsed")).distinct()


def status_words(s, d):
    return read_table(s, d, "match_polls").select("status", T.status_of(F.col("status")).alias("state"), T.rank_of(F.col("status")).alias("rank")).distinct()


def date_chunks(s, d):
    span = read_table(s, d, "match_polls").agg(F.to_date(F.min("polled_at")).alias("a"), F.to_date(F.max("polled_at")).alias("b"))
    return span.select(F.explode(T.date_chunks(F.col("a"), F.col("b"))).alias("day"))


def json_rows(s, d):
    return reads.as_json(read_table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"))


def rank_standings(s, d):
    n, c = read_table(s, d, "nation"), read_table(s, d, "customer")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("customers")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return reads.ranked(counts.select("n_regionkey", "n_name", "customers"), "n_regionkey", "customers", "n_name")


_NAMES = """latest_state list_matches events_since latest_of_type has_any_event finished_without_events find_by_name fold_names stale_folds
squad_order player_stats lineup_announced match_participants event_view card_counts snapshot_diff event_diff drift_classify drift_news replay_reveal step_reveal
record_union taxonomy_gate seq_stats upsert_last_wins masked_upsert accrued_state payload_merge captured_states closing_state merge_detail not_regressing flip_orientation window_nearest
resolve_authority feed_texts status_words date_chunks json_rows rank_standings""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_FOLD = "replace(lower(strip_accents(nfc_normalize(trim(display_name)))), 'ß', 'ss')"
#: A payload whatever the order of its keys.
_JSON = "case when json_valid({c}) then cast(list_sort(list_transform(json_keys({c}), lambda k: k || cast(json_extract({c}, '$.\"' || k || '\"') as varchar))) as varchar) else {c} end"
_RANK = "coalesce(map {{'UNKNOWN': -1, 'SCHEDULED': 0, 'IN_PLAY': 1, 'PAUSED': 1, 'FINISHED': 2}}[{c}], -1)"
_ALL_POLLS = "(select * from match_polls qualify row_number() over (partition by source, match_id, snapshot_no order by polled_at desc, status desc) = 1)"
#: Every snapshot's rows once, each source's snapshots with the one before, and both joined.
_EVERY_M = "(select * from match_polls qualify row_number() over (partition by source, match_id, snapshot_no order by polled_at desc, status desc, minute desc nulls last, score_home desc nulls last, score_away desc nulls last, display_clock desc nulls last, payload desc nulls last) = 1)"
_EVERY_E = "(select * from event_polls qualify row_number() over (partition by source, match_id, seq, snapshot_no order by polled_at desc, minute desc nulls last, period desc nulls last, type desc, importance desc, actor_entity desc nulls last, target_entity desc nulls last, detail desc nulls last, payload desc) = 1)"
_STEPS = "(select source, snapshot_no, lag(snapshot_no) over (partition by source order by snapshot_no) as prev from (select distinct source, snapshot_no from {t}) qualify prev is not null)"
_WHOLE = lambda a: ", ".join(f"{a}.{c}" for c in ("minute", "period", "type", "importance", "actor_entity", "target_entity", "detail")) + ", " + _JSON.format(c=f"{a}.payload")
_EVENT_DIFFS = f"""select a.snapshot_no, a.source, a.match_id, a.seq, case when b.source is null then 'new' else 'mutated' end as change
from {_EVERY_E} a join {_STEPS.format(t='event_polls')} s on s.source = a.source and s.snapshot_no = a.snapshot_no
left join {_EVERY_E} b on b.source = a.source and b.match_id = a.match_id and b.seq = a.seq and b.snapshot_no = s.prev where b.source is null or ({_WHOLE('a')}) is distinct from ({_WHOLE('b')})"""
_DRIFT = f"""with e as {_EVERY_E}, h as (select i.source, i.match_id, i.snapshot_no, max(o.seq) as head from (select distinct source, match_id, snapshot_no from e) i
join e o on o.source = i.source and o.match_id = i.match_id and o.snapshot_no < i.snapshot_no group by 1, 2, 3)
select i.snapshot_no, i.source, i.match_id, i.seq, case when k.source is not null and ({_WHOLE('k')}) is not distinct from ({_WHOLE('i')}) then 'resend' when k.source is not null then 'conflict'
when i.seq <= h.head then 'retroactive' else 'new' end as drift from e i join {_STEPS.format(t='event_polls')} s on s.source = i.source and s.snapshot_no = i.snapshot_no
left join e k on k.source = i.source and k.match_id = i.match_id and k.seq = i.seq and k.snapshot_no = (select max(o.snapshot_no) from e o where o.source = i.source and o.match_id = i.match_id and o.seq = i.seq and o.snapshot_no < i.snapshot_no)
left join h on h.source = i.source and h.match_id = i.match_id and h.snapshot_no = i.snapshot_no"""
_PAIRED = f"{_EVERY_M} a join {_STEPS.format(t='match_polls')} s on s.source = a.source and s.snapshot_no = a.snapshot_no {{how}} join {_EVERY_M} b on b.source = a.source and b.match_id = a.match_id and b.snapshot_no = s.prev"

#: The fold of a match's polls, o the state so far and n the next row.
_STATE = ("status", "minute", "display_clock", "score_home", "score_away", "home_team", "away_team")
_DONE = "coalesce({}.status = 'FINISHED', false)"
_VETOED = f"({_DONE.format('o')} = {_DONE.format('n')} and (coalesce(n.score_home < o.score_home, false) or coalesce(n.score_away < o.score_away, false)))"
_KEEPS = f"({_VETOED} or ({_DONE.format('o')} and not {_DONE.format('n')}))"
_CLOCK = lambda w, x, c, by: f"coalesce({w}.{c}, case when not {_VETOED} and ({x}.status is not distinct from {w}.status or ({_DONE.format('o')} and {_DONE.format('n')})) and ({w}.{by} is null or {x}.{by} is null or {w}.{by} = {x}.{by}) then {x}.{c} end)"
_EITHER = lambda a, b: f"case when {_KEEPS} then {a} else {b} end"
_FOLD_PARTS = {
    "status": _EITHER("o.status", "n.status"), "minute": _EITHER(_CLOCK("o", "n", "minute", "display_clock"), _CLOCK("n", "o", "minute", "display_clock")),
    "display_clock": _EITHER(_CLOCK("o", "n", "display_clock", "minute"), _CLOCK("n", "o", "display_clock", "minute")),
    "score_home": "greatest(o.score_home, n.score_home)", "score_away": "greatest(o.score_away, n.score_away)",
    "home_team": _EITHER("coalesce(o.home_team, n.home_team)", "coalesce(n.home_team, o.home_team)"), "away_team": _EITHER("coalesce(o.away_team, n.away_team)", "coalesce(n.away_team, o.away_team)"),
}
_FOLD_STEP = "{" + ", ".join(f"'{c}': {e}" for c, e in _FOLD_PARTS.items()) + "}"

ORACLES = {
    "event_diff": _EVENT_DIFFS,
    "snapshot_diff": f"""with n as (select snapshot_no, source, match_id, count(*) as k from ({_EVENT_DIFFS}) group by 1, 2, 3)
select a.snapshot_no, a.source, a.match_id, (b.source is null or (a.status, a.minute, a.score_home, a.score_away, a.display_clock, {_JSON.format(c='a.payload')}) is distinct from (b.status, b.minute, b.score_home, b.score_away, b.display_clock, {_JSON.format(c='b.payload')})) as state_changed,
coalesce(n.k, 0) as new_events from {_PAIRED.format(how='left')} left join n on n.source = a.source and n.match_id = a.match_id and n.snapshot_no = a.snapshot_no""",
    "drift_classify": _DRIFT,
    "drift_news": f"""with d as ({_DRIFT}), l as (select *, lag(drift) over (partition by source, match_id, seq order by snapshot_no) as was from d)
select snapshot_no, source, match_id, seq, drift from l where drift in ('conflict', 'retroactive') and drift is distinct from was""",
    "merge_detail": f"""with j as (select a.snapshot_no, a.source, a.match_id, a.status bs, a.minute bm, a.display_clock bc, a.score_home bh, a.score_away ba, a.payload ->> '$.kickoff_utc' bk,
b.status ds, b.minute dm, b.display_clock dc, b.score_home dh, b.score_away da, b.payload ->> '$.kickoff_utc' dk, {_RANK.format(c='b.status')} < {_RANK.format(c='a.status')} as behind from {_PAIRED.format(how='')})
select snapshot_no, source, match_id, case when behind then bs else ds end as status, case when behind then bm else dm end as minute, case when behind then bc else dc end as display_clock,
case when behind and bh is not null then bh else coalesce(dh, bh) end as score_home, case when behind and ba is not null then ba else coalesce(da, ba) end as score_away, coalesce(dk, bk) as kickoff_utc from j""",
    "not_regressing": f"""with j as (select a.snapshot_no, a.source, a.match_id, a.status ss, a.minute sm, a.display_clock sc, b.status cs, b.minute cm, b.display_clock cc,
coalesce(a.status = 'FINISHED', false) as done, coalesce(b.status = 'FINISHED', false) as real, greatest(a.score_home, b.score_home) as score_home, greatest(a.score_away, b.score_away) as score_away from {_PAIRED.format(how='')})
select snapshot_no, source, match_id, case when done and not real then ss else cs end as status, case when done then coalesce(cm, sm) else cm end as minute, case when done then coalesce(cc, sc) else cc end as display_clock, score_home, score_away,
'FINISHED' as status_forced, case when real then cm end as x1, score_home as score_home_forced, score_away as score_away_forced,
case when real then coalesce(cm, case when done then sm end) else case when done then sm end end as minute_forced, case when real then coalesce(cc, case when done then sc end) else case when done then sc end end as display_clock_forced from j""".replace("case when real then cm end as x1, ", ""),
    "latest_state": f"""with e as {_E}, h as (select match_id, max(seq) as head, count(*) as n from e group by 1),
k as (select match_id, type from e where type in ('kickoff', 'half_time', 'full_time') qualify row_number() over (partition by match_id order by seq desc) = 1)
select m.match_id, m.source, m.status, coalesce(h.head, -1) as head, coalesce(h.n, 0) as n_events, coalesce(k.type, lower(m.status)) as phase
from {_M} m left join h using (match_id) left join k using (match_id)""",
    "list_matches": f"select source, match_id, kickoff_utc, status, score_home, score_away from {_M} where status = 'FINISHED'",
    "events_since": f"select source, match_id, seq, type, minute from {_E} where seq > 3",
    "latest_of_type": f"select source, match_id, seq, type from {_E} where type in ('kickoff', 'half_time', 'full_time') qualify row_number() over (partition by source, match_id order by seq desc) = 1",
    "has_any_event": f"select source, match_id from {_M} where match_id in (select match_id from event_polls)",
    "finished_without_events": f"select source, count(*) as n from {_M} m where status = 'FINISHED' and not exists (select 1 from event_polls e where e.source = m.source and e.match_id = m.match_id) group by 1",
    "find_by_name": f"select distinct source, entity_id, kind from entities where {_FOLD} = name_folded",
    "fold_names": f"select distinct source, entity_id, md5({_FOLD}) as fold from entities",
    "stale_folds": f"select source, kind, count(*) filter (where {_FOLD} is distinct from name_folded) as stale, count(*) as n from entities group by 1, 2",
    "squad_order": """select source, match_id, team, athlete_id, row_number() over (partition by source, match_id, team order by formation_place asc nulls last, athlete_id) as place
from (select distinct source, match_id, team, athlete_id, formation_place from football_lineups)""",
    "player_stats": f"select distinct source, match_id, team, possession, shots, corners from (select distinct * exclude (collected_at) from football_stats) s where exists (select 1 from {_M} m where m.source = s.source and m.match_id = s.match_id)",
    "lineup_announced": "select source, match_id, team, bool_or(coalesce(starter = 1, false)) as announced from football_lineups group by 1, 2, 3",
    "match_participants": f"""with p as (select source, match_id, case when json_valid(payload) then payload end as p, score_home, score_away from {_M})
select source, match_id, p ->> '$.home_team' as name, 'home' as side, score_home as score from p where coalesce(p ->> '$.home_team', '') <> ''
union all select source, match_id, p ->> '$.away_team', 'away', score_away from p where coalesce(p ->> '$.away_team', '') <> ''""",
    "event_view": f"""select source, match_id, seq, type, payload ->> '$.team' as team, coalesce(payload ->> '$.scorer', payload ->> '$.player') as player, payload ->> '$.assist' as assist,
case when type in ('kickoff', 'half_time', 'full_time') then type end as phase from {_E}""",
    "card_counts": f"select source, match_id, payload ->> '$.team' as team, count(*) filter (where type = 'yellow') as yellow, count(*) filter (where type = 'red') as red from {_E} where type in ('yellow', 'red') and payload ->> '$.team' is not null group by 1, 2, 3",
    "replay_reveal": f"""with e as (select *, max(case when coalesce(minute, 0) * 60 > 2400 then 1 else 0 end) over (partition by source, match_id order by seq) as blocked from {_E})
select source, match_id, count(*) as n, max(seq) as head from e where blocked = 0 group by 1, 2""",
    "step_reveal": f"select source, match_id, seq, type from {_E} qualify row_number() over (partition by source, match_id order by seq) <= 3",
    "record_union": f"select source, match_id, seq, type, minute, detail from {_E}",
    "taxonomy_gate": "select type, count(*) as n from (select type from event_polls union all select event_type from events) where type is null or type not in ('goal', 'own_goal', 'penalty', 'yellow', 'red', 'sub', 'kickoff', 'half_time', 'full_time') group by 1",
    "seq_stats": f"select source, match_id, min(seq) as first, max(seq) as head, count(*) as n, max(seq) - min(seq) + 1 - count(*) as gaps from {_E} group by 1, 2",
    "upsert_last_wins": "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc) = 1",
    "masked_upsert": f"""with p as {_ALL_POLLS}, k as (select distinct source, match_id from p),
a as (select source, match_id, status from p where snapshot_no % 2 = 1 qualify row_number() over (partition by source, match_id order by snapshot_no desc) = 1),
b as (select source, match_id, minute from p where snapshot_no % 2 = 0 qualify row_number() over (partition by source, match_id order by snapshot_no desc) = 1),
c as (select source, match_id, score_home from p qualify row_number() over (partition by source, match_id order by snapshot_no desc) = 1)
select k.source, k.match_id, a.status, b.minute, c.score_home from k left join a using (source, match_id) left join b using (source, match_id) left join c using (source, match_id)""",
    "accrued_state": f"""with p as (select *, payload ->> '$.home_team' as home_team, payload ->> '$.away_team' as away_team from {_EVERY_M}),
f as (select source, match_id, list_reduce(list({{{', '.join(f"'{c}': {c}" for c in _STATE)}}} order by snapshot_no), lambda o, n: {_FOLD_STEP}) as r from p group by 1, 2)
select source, match_id, {', '.join(f'r.{c}' for c in _STATE)} from f""",
    "payload_merge": f"""with j as (select a.snapshot_no, a.source, a.match_id, case when json_valid(b.payload) then b.payload else '{{}}' end as o, case when json_valid(a.payload) then a.payload else '{{}}' end as n from {_PAIRED.format(how='')}),
k as (select *, list_sort(list_distinct(list_concat(json_keys(o), json_keys(n)))) as keys from j)
select snapshot_no, source, match_id, '{{' || array_to_string(list_transform(keys, lambda k: to_json(k) || ':' || coalesce(case when cast(json_extract(n, '$."' || k || '"') as varchar) not in ('null', '""', '[]', '{{}}') then json_extract(n, '$."' || k || '"') end, json_extract(o, '$."' || k || '"'), json_extract(n, '$."' || k || '"'))), ',') || '}}' as payload from k""",
    "captured_states": f"""with l as (select snapshot_no, source, match_id, status, minute, score_home, score_away, lag(true) over w as seen, lag(status) over w as os, lag(minute) over w as om, lag(score_home) over w as oh, lag(score_away) over w as oa
from {_EVERY_M} window w as (partition by source, match_id order by snapshot_no))
select snapshot_no, source, match_id, case when seen then oh is not null or oa is not null or coalesce(os = 'FINISHED', false) end as kept,
case when seen then not (oh is not null and (score_home is null or score_home < oh)) and not (oa is not null and (score_away is null or score_away < oa))
and (coalesce(score_home > oh, false) or coalesce(score_away > oa, false) or (oh is not null and oa is not null and coalesce(minute > om, false))) end as disproved,
case when seen then coalesce(os in ('IN_PLAY', 'PAUSED'), false) and not coalesce(status in ('IN_PLAY', 'PAUSED'), false) end as "off", coalesce(status = 'FINISHED', false) and seen is null as late from l""",
    "flip_orientation": f"""select source, match_id, case when score_away > score_home then away_entity else home_entity end as home_entity, case when score_away > score_home then home_entity else away_entity end as away_entity,
case when score_away > score_home then score_away else score_home end as score_home, case when score_away > score_home then score_home else score_away end as score_away from {_M}""",
    "window_nearest": """select p.event_id as id, e.event_id as rid from events p join events e on p.user_id = e.user_id and p.event_type = 'purchase' and e.event_type = 'error'
and abs(date_diff('second', p.ts, e.ts)) <= 10800 qualify row_number() over (partition by p.event_id order by abs(date_diff('second', p.ts, e.ts)), e.event_id) = 1""",
    "resolve_authority": """with r as (select distinct home_entity, match_id, updated_at, cast(case when contains(match_id, ':') then 1 when contains(match_id, '_vs_') then 0 else 2 end as bigint) as rank from matches where match_id is not null and home_entity is not null)
select home_entity, match_id, rank from r qualify row_number() over (partition by home_entity order by rank, updated_at desc nulls last, match_id) = 1""",
    "feed_texts": "select distinct g.minute as minute, try_cast(trim(split_part(replace(g.minute, '''', ''), '+', 1)) as int) as parsed from (select unnest(goals1) as g from worldcup union all select unnest(goals2) from worldcup) where g.minute is not null",
    "status_words": f"select distinct status, coalesce(map {{'SCHEDULED': 'SCHEDULED', 'IN_PLAY': 'IN_PLAY', 'PAUSED': 'PAUSED', 'FINISHED': 'FINISHED'}}[status], 'UNKNOWN') as state, {_RANK.format(c='status')} as rank from match_polls",
    "date_chunks": "select strftime(unnest(generate_series(a - interval 1 day, b + interval 1 day, interval 1 day)), '%Y%m%d') as day from (select cast(min(polled_at) as date) as a, cast(max(polled_at) as date) as b from match_polls)",
    "json_rows": """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as json from nation""",
    "rank_standings": "select n_regionkey, n_name, customers, row_number() over (partition by n_regionkey order by customers desc, n_name) as rank from (select c_nationkey, count(*) as customers from customer group by 1) join nation on c_nationkey = n_nationkey",
}
