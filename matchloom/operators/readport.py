"""Reads of side tables and the port that consumers read matches through: one DataFrame each, for any number of matches.

A name given by a caller is compared by team key or by fold, as the stored one is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.feed import team_key
from matchloom.functions.text import fold


class UnknownName(ValueError):
    """A column or an order that a table does not have."""


def ordered(rows: DataFrame, order_by: tuple[str, ...] = ()) -> DataFrame:
    """rows by columns that they have, each with an optional ``desc``; nulls come first, or last when descending."""
    keys = []
    for term in order_by:
        name, _, way = term.partition(" ")
        if name not in rows.columns or way not in ("", "asc", "desc"):
            raise UnknownName(term)
        keys.append(F.desc_nulls_last(name) if way == "desc" else F.asc_nulls_first(name))
    return rows.orderBy(*keys) if keys else rows


def side_rows(rows: DataFrame, order_by: tuple[str, ...] = (), limit: int | None = None, **equal: str) -> DataFrame:
    """Rows of a side table that equal the given columns, in order, the first ``limit`` of them."""
    for name, value in equal.items():
        if name not in rows.columns:
            raise UnknownName(name)
        rows = rows.where(F.col(name) == value)
    rows = ordered(rows, order_by)
    return rows if limit is None else rows.limit(limit)


def first_per(rows: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    """The first rows of each key; what ``side_rows`` with a limit does for one key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")


def with_source(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of matches that are stored, by the source that owns each."""
    return rows.join(matches.select("source", "match_id").distinct(), ["source", "match_id"], "left_semi")


def entity(entities: DataFrame, source: str, entity_id: str) -> DataFrame:
    return side_rows(entities, source=source, entity_id=entity_id)


def keyed_teams(rows: DataFrame, team: str = "team") -> DataFrame:
    """rows with ``team_key``; the key is made once per distinct name."""
    names = rows.select(team).distinct().withColumn("team_key", team_key(F.col(team)))
    return rows.join(names, team, "left").select(*rows.columns, "team_key")


def lineup(lineups: DataFrame, participant: str | None = None) -> DataFrame:
    """Line-ups by match and team, in order of the formation; of one participant if given, compared by team key."""
    if participant is not None:
        lineups = keyed_teams(lineups).where(F.col("team_key") == team_key(F.lit(participant))).drop("team_key")
    return lineups.orderBy("match_id", "team", F.asc_nulls_last("formation_place"), "athlete_id")


def roster(rosters: DataFrame, participant: str) -> DataFrame:
    """A team's roster by number, compared by team key."""
    return keyed_teams(rosters).where(F.col("team_key") == team_key(F.lit(participant))).drop("team_key").orderBy("number")


def in_roster(rosters: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(participant, name) with ``found``: whether the roster of a team of that key has a player of that fold."""
    have = keyed_teams(rosters).select(F.col("team_key").alias("k"), fold("player_name").alias("f")).distinct().withColumn("found", F.lit(True))
    keyed = keyed_teams(asked, "participant").withColumnRenamed("team_key", "k").withColumn("f", fold("name"))
    return keyed.join(have, ["k", "f"], "left").select(*asked.columns, F.coalesce("found", F.lit(False)).alias("found"))


def player_in_lineup(lineups: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(source, match_id, name) with the first row of the match's line-up whose player has that fold; no row where none has."""
    order = [F.col("team"), F.asc_nulls_last("formation_place"), F.col("athlete_id")]
    named = lineups.withColumn("f", fold("display_name"))
    found = asked.distinct().withColumn("f", fold("name")).join(named, ["source", "match_id", "f"]).drop("f")
    return first_per(found, ["source", "match_id", "name"], order)


def recent_commentary(commentary: DataFrame | None, limit: int = 20) -> DataFrame | None:
    """Per match the latest comments (match_id, created_at, id, text), newest first; nothing where there is no such table."""
    return None if commentary is None else first_per(commentary, ["match_id"], [F.desc_nulls_last("created_at"), F.desc("id")], limit)


def unknown_to(store: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that the store does not have."""
    return ids.join(store, keys, "left_anti")


def skippable(candidates: DataFrame, matches: DataFrame, events: DataFrame) -> DataFrame:
    """candidates(source, match_id) that need no fetch: stored for the same source, and with events."""
    keys = ["source", "match_id"]
    return candidates.join(matches.select(*keys), keys, "left_semi").join(events.select(*keys), keys, "left_semi")
