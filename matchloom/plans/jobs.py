"""Queries of backfill, cursors and recordings, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import registry
from matchloom.operators import backfill as B
from matchloom.plans.records import _E, _events
from matchloom.sources import read_table
from matchloom.sources import recordings as R


def _planned(s, d):
    polls = read_table(s, d, "match_polls")
    schedule = polls.select("source", "match_id", "status", F.date_format("polled_at", "yyyyMMdd").alias("day"))
    span = polls.agg(F.to_date(F.min("polled_at")).alias("a"), F.to_date(F.max("polled_at")).alias("b"))
    stored = polls.where("snapshot_no <= 4").select("source", "match_id")
    return B.plan(schedule, B.chunks(span, "a", "b"), stored, _events(s, d))


def backfill_plan(s, d):
    return _planned(s, d)


def backfill_report(s, d):
    """What comes of a job whose details are the other tables' rows: line-ups without starters are broken."""
    details = read_table(s, d, "event_polls").where("match_id is not null").select("source", "match_id", F.when(F.col("seq") > 12, "long").alias("fault"))
    return B.tallies(B.apply(_planned(s, d), details))


def reader_cursor(s, d):
    """What a reader that has seen the first four snapshots has not read yet."""
    seen = read_table(s, d, "event_polls").where("snapshot_no <= 4").select("source", "match_id", "seq")
    return B.cursor(_events(s, d), seen).select("source", "match_id", "seq", "type")


def recording_stems(s, d):
    return read_table(s, d, "matches").where("match_id is not null").select("match_id", R.stem(F.col("match_id")).alias("stem")).distinct()


def recorded(s, d):
    """Every match's recording: how many events its document holds, and the last of them."""
    polls = read_table(s, d, "match_polls")
    told = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    last = polls.groupBy("match_id").agg(F.max_by(F.struct("status", "minute", "score_home", "score_away", "display_clock", told("home_team"), told("away_team"), told("kickoff_utc"), "payload"), F.struct("snapshot_no", "polled_at", "source")).alias("m"))
    e = _events(s, d)
    side = lambda n: F.get_json_object("payload", f"$.{n}")
    events = e.select("match_id", "seq", "minute", F.col("type").alias("event_type"), "importance", side("team").alias("team"), F.coalesce(side("scorer"), side("player")).alias("player"), side("assist").alias("assist"), "detail")
    docs = R.documents(last.select("match_id", "m.*"), events)
    at = lambda p: F.get_json_object("document", p)
    return docs.select("match_id", at("$.format_version").alias("version"), F.coalesce(F.size(F.from_json(at("$.events"), "array<string>")), F.lit(0)).alias("n"), at("$.events[0].event_type").alias("first"))


def event_words(s, d):
    return registry.vocabulary(s)


_NAMES = "backfill_plan backfill_report reader_cursor recording_stems recorded event_words".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_PLAN = "select source, match_id, case when exists (select 1 from match_polls o where o.snapshot_no <= 4 and o.source = p.source and o.match_id = p.match_id) and exists (select 1 from event_polls e where e.source = p.source and e.match_id = p.match_id) then 'skipped' else 'due' end as outcome from (select distinct source, match_id from match_polls where status = 'FINISHED') p"
ORACLES = {
    "backfill_plan": _PLAN,
    "backfill_report": f"""with d as (select match_id, min(source) as came, max(case when seq > 12 then 1 else 0 end) as broken from event_polls where match_id is not null group by 1),
o as (select p.source, case when outcome = 'skipped' then outcome when came <> p.source then 'foreign' when came is null or broken = 1 then 'failed' else 'applied' end as outcome from ({_PLAN}) p left join d using (match_id))
select source, count(*) as enumerated, count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'applied') as applied, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'foreign') as "foreign" from o group by 1""",
    "reader_cursor": f"select source, match_id, seq, type from {_E} e where seq > coalesce((select max(seq) from event_polls o where o.snapshot_no <= 4 and o.source = e.source and o.match_id = e.match_id), -1)",
    "recording_stems": r"select distinct match_id, regexp_replace(match_id, '[^\p{L}\p{N}_.-]', '_', 'g') || '-' || left(sha1(match_id), 8) as stem from matches where match_id is not null",
    "recorded": f"with m as (select distinct match_id from match_polls), e as (select match_id, count(*) as n, arg_min(type, (seq, source)) as first from {_E} group by 1) select match_id, '1' as version, cast(coalesce(n, 0) as int) as n, first from m left join e using (match_id)",
    "event_words": "select * from (values ('goal', 'Goal', 1), ('own_goal', 'Own goal', 1), ('penalty', 'Penalty', 1), ('yellow', 'Yellow card', 3), ('red', 'Red card', 2), ('sub', 'Substitution', 4), ('kickoff', 'Kickoff', 3), ('half_time', 'Half time', 3), ('full_time', 'Full time', 2)) t(type, display_name, importance)",
}
