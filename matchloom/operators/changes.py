"""Diffs of polls, drift of sequences and replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import canonical_json

# What is compared of an event, and of a match where the poll has it.
EVENT_KEY = ("minute", "period", "type", "importance", "actor_entity", "target_entity", "detail", "payload")
STATE_KEY = ("status", "minute", "score_home", "score_away", "display_clock", "home_team", "away_team", "kickoff_utc", "payload")


def fingerprint(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The named columns that df has as one value; payloads are compared as JSON, whatever the order of their keys."""
    return F.struct(*[canonical_json(F.col(n)).alias(n) if n == "payload" else F.col(n) for n in names if n in df.columns])


def one_per_poll(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of one key in one snapshot the one polled last, of equal times the greatest."""
    rest = [c for c in polls.columns if c not in keys and c not in ("snapshot_no", "polled_at")]
    return polls.groupBy("snapshot_no", *keys).agg(F.max(F.struct("polled_at", *rest)).alias("r")).select("snapshot_no", *keys, "r.*")


def steps(polls: DataFrame) -> DataFrame:
    """(source, snapshot_no, before): each snapshot of a source with the one the source delivered before it; the first has none."""
    order = Window.partitionBy("source").orderBy("snapshot_no")
    return polls.select("source", "snapshot_no").distinct().withColumn("before", F.lag("snapshot_no").over(order)).where("before is not null")


def step_pairs(polls: DataFrame, keys: list[str], value: Callable[[DataFrame], Column], how: str) -> DataFrame:
    """(snapshot_no, *keys, now, old): each key's value in a snapshot and in its source's previous one."""
    rows = one_per_poll(polls, keys)
    rows = rows.select("snapshot_no", *keys, value(rows).alias("now"))
    old = rows.select(F.col("snapshot_no").alias("before"), *keys, F.col("now").alias("old"))
    return rows.join(steps(polls), ["source", "snapshot_no"]).join(old, [*keys, "before"], how).select("snapshot_no", *keys, "now", "old")


def event_diff(events: DataFrame) -> DataFrame:
    """(snapshot_no, source, match_id, seq, change): events that the source's previous snapshot lacks (new) or has otherwise (mutated)."""
    keys = ["source", "match_id", "seq"]
    pairs = step_pairs(events, keys, lambda df: fingerprint(df, EVENT_KEY), "left").where(~F.col("now").eqNullSafe(F.col("old")))
    return pairs.select("snapshot_no", *keys, F.when(F.col("old").isNull(), "new").otherwise("mutated").alias("change"))


def diff_polls(polls: DataFrame, events: DataFrame) -> DataFrame:
    """Per match of every snapshot but a source's first: whether its state changed, and how many events are new or mutated.

    A first sight is a change and all its events are new; removed events are no change.
    """
    keys = ["snapshot_no", "source", "match_id"]
    state = step_pairs(polls, keys[1:], lambda df: fingerprint(df, STATE_KEY), "left").select(*keys, (~F.col("now").eqNullSafe(F.col("old"))).alias("state_changed"))
    fresh = event_diff(events).groupBy(*keys).agg(F.count("*").alias("new_events"))
    return state.join(fresh, keys, "left").select(*keys, "state_changed", F.coalesce("new_events", F.lit(0)).alias("new_events"))


def poll_drift(events: DataFrame) -> DataFrame:
    """(snapshot_no, source, match_id, seq, drift) of every snapshot but a source's first, against all that was stored before it."""
    keys = ["source", "match_id", "seq"]
    rows = one_per_poll(events, keys)
    rows = rows.select("snapshot_no", *keys, fingerprint(rows, EVENT_KEY).alias("now"))
    head = F.max("seq").over(Window.partitionBy("source", "match_id").orderBy("snapshot_no").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"kept": F.lag("now").over(Window.partitionBy(*keys).orderBy("snapshot_no")), "head": head})
    return rows.join(steps(events), ["source", "snapshot_no"], "left_semi").select("snapshot_no", *keys, _drift(F.lit(1)).alias("drift"))


def _drift(copy: Column) -> Column:
    """What a row is, from its value ``now``, the stored ``kept``, the stored ``head`` and which copy of its seq it is."""
    return (
        F.when(F.col("seq").isNull(), "malformed")
        .when(F.col("kept").isNotNull() & F.col("kept").eqNullSafe(F.col("now")), "resend")
        .when(F.col("kept").isNotNull(), "conflict")
        .when(F.col("seq") <= F.col("head"), "retroactive")
        .when(copy > 1, "duplicate")
        .otherwise("new")
    )


def classify_drift(stored: DataFrame, incoming: DataFrame, arrival: str | None = None) -> DataFrame:
    """incoming with ``drift``: malformed, resend, conflict, retroactive, duplicate or new.

    Against what is stored per (source, match_id): a known seq with the same
    fingerprint is a resend, with another one a conflict (the stored row stays);
    an unknown seq up to the head is retroactive and never written; above the head
    the copy of a seq that arrived first is new, the others are duplicates. Without
    an ``arrival`` column the copies come in the order of their values. A row
    without seq is malformed. No seq is ever both stored and new, so a stored
    seq that comes twice is compared twice.
    """
    keys = ["source", "match_id"]
    heads = stored.groupBy(*keys).agg(F.max("seq").alias("head"))
    known = stored.select(*keys, "seq", fingerprint(stored, tuple(c for c in EVENT_KEY if c in incoming.columns)).alias("kept"))
    order = [arrival] if arrival else [c for c in EVENT_KEY if c in incoming.columns]
    numbered = incoming.withColumns({"copy": F.row_number().over(Window.partitionBy(*keys, "seq").orderBy(*order)), "now": fingerprint(incoming, EVENT_KEY)})
    joined = numbered.join(known, [*keys, "seq"], "left").join(heads, keys, "left")
    return joined.withColumn("drift", _drift(F.col("copy"))).select(*incoming.columns, "drift")


def drift_news(drift: DataFrame) -> DataFrame:
    """Rows (snapshot_no, source, match_id, seq, drift) with ``first``: whether the seq's drift was another at its match's last report of it.

    A conflict or late event is reported once; when it has come right in between it is reported again.
    """
    order = Window.partitionBy("source", "match_id", "seq").orderBy("snapshot_no")
    loud = F.col("drift").isin("conflict", "retroactive", "malformed")
    return drift.withColumn("first", loud & ~F.col("drift").eqNullSafe(F.lag("drift").over(order)))


def replay(events: DataFrame, elapsed_s: float, speed: float = 60.0) -> DataFrame:
    """The longest prefix by seq whose minutes have come; it stops at the first later event."""
    order = Window.partitionBy("source", "match_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    late = (F.coalesce("minute", F.lit(0)) * 60 > elapsed_s * speed).cast("int")
    return events.withColumn("blocked", F.max(late).over(order)).where("blocked = 0").drop("blocked")


def step(events: DataFrame, count: int) -> DataFrame:
    """The first events of each match by seq."""
    order = Window.partitionBy("source", "match_id").orderBy("seq")
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


def record_union(events: DataFrame) -> DataFrame:
    """All events ever polled, of each seq the copy polled last."""
    keys = ["source", "match_id", "seq"]
    rest = [c for c in events.columns if c not in keys and c not in ("snapshot_no", "polled_at")]
    return events.groupBy(*keys).agg(F.max(F.struct("snapshot_no", "polled_at", *rest)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def outside_taxonomy(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Events of a type that is not declared; an empty result lets a batch pass."""
    return events.where(~F.col("type").isin(*types) | F.col("type").isNull())


def not_increasing(events: DataFrame, arrival: str) -> DataFrame:
    """Rows whose seq is not above the one that arrived before it in the same match."""
    order = Window.partitionBy("source", "match_id").orderBy(arrival)
    return events.withColumn("before", F.lag("seq").over(order)).where(F.col("seq") <= F.col("before")).drop("before")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
