"""Registered read operations: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import fold

# Event types that mark a phase of play.
MARKERS = ("kickoff", "half_time", "full_time")


def current_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last delivery of each key by ``order``; nulls come first. One aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest))
    return df.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def list_matches(matches: DataFrame, source: str | None = None, status: str | None = None) -> DataFrame:
    """All columns, by kick-off text (nulls first) and id; each filter only if given."""
    for name, value in (("source", source), ("status", status)):
        if value is not None:
            matches = matches.where(F.col(name) == value)
    return matches.orderBy(F.asc_nulls_first("kickoff_utc"), "match_id")


def standings(rows: DataFrame, source: str, group_key: str | None = None) -> DataFrame:
    """Standings of a source by group, stored rank and id; of one group if given."""
    rows = rows.where(F.col("source") == source)
    if group_key is not None:
        rows = rows.where(F.col("group_key") == group_key)
    return rows.orderBy("group_key", "rank", "entity_id")


def events_since(events: DataFrame, match_id: str | None = None, since_seq: int = -1) -> DataFrame:
    """Events of a match, or of each, with a greater seq, in order; beyond the head there are none."""
    if match_id is not None:
        events = events.where(F.col("match_id") == match_id)
    return events.where(F.col("seq") > since_seq).orderBy("match_id", "seq")


def latest_of_type(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Per match the event with the greatest seq among ``types``; no types, no rows."""
    return events.where(F.col("type").isin(*types)).groupBy("source", "match_id").agg(F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"))


def latest_state(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Per match its status, head, event count and phase: the latest marker, else the status in lower case."""
    marker = F.col("type").isin(*MARKERS)
    heads = events.groupBy("match_id").agg(
        F.max("seq").alias("head"), F.count("*").alias("n_events"), F.max_by("type", F.when(marker, F.col("seq"))).alias("marker"), F.max(marker).alias("marked")
    )
    phase = F.when(F.col("marked"), F.col("marker")).otherwise(F.lower("status"))
    return matches.join(heads, "match_id", "left").select("match_id", "source", "status", F.coalesce("head", F.lit(-1)).alias("head"), F.coalesce("n_events", F.lit(0)).alias("n_events"), phase.alias("phase"))


def has_any_event(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Matches with at least one event."""
    return matches.join(events.select("match_id"), "match_id", "left_semi")


def ended_without_events(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Finished matches that have no event at all."""
    keys = ["source", "match_id"]
    return matches.where("status = 'FINISHED'").join(events.select(*keys), keys, "left_anti")


def seq_stats(events: DataFrame) -> DataFrame:
    """Per match its first seq, its head, how many events it has and how many seqs are missing in between."""
    return events.groupBy("source", "match_id").agg(
        F.min("seq").alias("first"), F.max("seq").alias("head"), F.count("*").alias("n"), (F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("gaps")
    )


def ranked(rows: DataFrame, group: str, points: str, name: str) -> DataFrame:
    """rows with ``rank`` by points within their group, equals by name."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(points), name)).cast("bigint"))


def find_by_name(entities: DataFrame, name: Column, source: str | None = None, kind: str | None = None) -> DataFrame:
    """Entities whose stored fold equals the folded name, by source and id."""
    for column, value in (("source", source), ("kind", kind)):
        if value is not None:
            entities = entities.where(F.col(column) == value)
    return entities.where(F.col("name_folded") == fold(name)).orderBy("source", "entity_id")


def participants(matches: DataFrame) -> DataFrame:
    """Per match an array of {name, side, score} of the sides whose name the payload tells."""
    side = lambda n: F.struct(F.get_json_object("payload", f"$.{n}_team").alias("name"), F.lit(n).alias("side"), F.col(f"score_{n}").alias("score"))
    return matches.select("source", "match_id", F.filter(F.array(side("home"), side("away")), lambda p: p["name"].isNotNull() & (p["name"] != "")).alias("participants"))


def event_view(events: DataFrame) -> DataFrame:
    """Events with team, player and assist from the payload, and the phase of markers.

    Rows written before goals had a scorer keep their player.
    """
    text = lambda p: F.get_json_object("payload", p)
    return events.select(
        "source", "match_id", "seq", "type", text("$.team").alias("team"), F.coalesce(text("$.scorer"), text("$.player")).alias("player"), text("$.assist").alias("assist"),
        F.when(F.col("type").isin(*MARKERS), F.col("type")).alias("phase"),
    )


def squad(lineups: DataFrame, top: int | None = None) -> DataFrame:
    """Line-ups by team, place in the formation (nulls last) and athlete; the first ``top`` of each team if given."""
    order = Window.partitionBy("source", "match_id", "team").orderBy(F.asc_nulls_last("formation_place"), "athlete_id")
    numbered = lineups.withColumn("place", F.row_number().over(order))
    return numbered if top is None else numbered.where(F.col("place") <= top)


def announced(lineups: DataFrame) -> DataFrame:
    """Per team and match whether any starter is named."""
    return lineups.groupBy("source", "match_id", "team").agg(F.bool_or(F.coalesce(F.col("starter") == 1, F.lit(False))).alias("announced"))


def card_counts(events: DataFrame) -> DataFrame:
    """Cards per match and team; cards of no team are left out."""
    cards = events.where(F.col("type").isin("yellow", "red")).withColumn("team", F.get_json_object("payload", "$.team")).where("team is not null")
    return cards.groupBy("source", "match_id", "team").agg(F.count_if(F.col("type") == "yellow").alias("yellow"), F.count_if(F.col("type") == "red").alias("red"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
