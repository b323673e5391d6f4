"""Scalar functions on texts of match records; built-in expressions except for the name fold."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from matchloom.functions.columns import lookup

# Status words of feeds and the lifecycle they mean: short codes, long words, descriptions.
STATUS = {
    "1H": "IN_PLAY", "2H": "IN_PLAY", "HT": "PAUSED", "FT": "FINISHED", "PEN": "FINISHED", "NS": "SCHEDULED",
    "IN_PLAY": "IN_PLAY", "LIVE": "IN_PLAY", "PAUSED": "PAUSED", "FINISHED": "FINISHED", "SCHEDULED": "SCHEDULED", "TIMED": "SCHEDULED",
    "Full Time": "FINISHED", "Half Time": "PAUSED", "Halftime": "PAUSED", "In Progress": "IN_PLAY",
    "First Half": "IN_PLAY", "Second Half": "IN_PLAY", "Scheduled": "SCHEDULED",
}
# Coarse states of a feed, used where the description is not known.
STATE = {"pre": "SCHEDULED", "in": "IN_PLAY", "post": "FINISHED"}
# Rank of a lifecycle state.
RANK = {"UNKNOWN": -1, "SCHEDULED": 0, "IN_PLAY": 1, "PAUSED": 1, "FINISHED": 2}


def fold_text(text: str | None) -> str | None:
    """Compatibility form without combining marks, caseless and trimmed; null stays null."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold().strip()


@F.arrow_udf(StringType())
def fold(texts: pa.Array) -> pa.Array:
    """fold_text over Arrow batches."""
    return pa.array([fold_text(t) for t in texts.to_pylist()], pa.string())


def minute_of(clock: Column) -> Column:
    """Game minute of a clock text, added time left out: "90'+6'" is 90; unreadable is null."""
    return F.trim(F.split(F.replace(clock, F.lit("'"), F.lit("")), "[+]")[0]).try_cast("int")


def possession_of(text: Column) -> Column:
    """Percentage as a number: "46%" is 46.0; unreadable is null."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def status_of(description: Column, state: Column | None = None) -> Column:
    """Lifecycle state of a feed's description, as written; else of its coarse state; else UNKNOWN."""
    coarse = [] if state is None else [F.try_element_at(lookup(STATE.items()), state)]
    return F.coalesce(F.try_element_at(lookup(STATUS.items()), description), *coarse, F.lit("UNKNOWN"))


def rank_of(status: Column) -> Column:
    """Order of a lifecycle state; unknown and null come first."""
    return F.coalesce(F.try_element_at(lookup(RANK.items()), status), F.lit(-1))


def goal_type(slug: Column) -> Column:
    """own_goal or goal for a feed's goal slugs, own goals first; null for any other slug."""
    return F.when(slug.rlike("^own-goal|^own---"), "own_goal").when(slug.rlike("^(penalty-goal|goal)$|^goal---"), "goal")


def city_of(place: Column) -> Column:
    """The part before the first comma."""
    return F.trim(F.split(place, ",")[0])


def key_text(text: Column) -> Column:
    """Plain decimals without a fraction become integers; every other key stays as written."""
    plain = text.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$")
    value = text.try_cast("decimal(38,9)")
    return F.when(plain & (value == F.floor(value)), F.floor(value).cast("decimal(38,0)").cast("string")).otherwise(text)


def date_chunks(first: Column, last: Column) -> Column:
    """yyyyMMdd of every day from the day before first to the day after last; none if first is after last."""
    days = F.sequence(F.date_sub(first, 1), F.date_add(last, 1))
    return F.when(first <= last, F.transform(days, lambda d: F.date_format(d, "yyyyMMdd"))).otherwise(F.array().cast("array<string>"))


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order; a text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def shrink(payload: Column) -> Column:
    """JSON object text as a map of JSON texts; {} where it is unreadable or no object."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def empty_value(value: Column) -> Column:
    """Whether a payload value (VARIANT) says nothing: null, "", [] or {}; 0, false and the text "[]" are data."""
    return value.isNull() | F.is_variant_null(value) | F.to_json(value).isin('""', "[]", "{}")
