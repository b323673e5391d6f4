"""Scalar functions on values of provider feeds: JSON values (VARIANT) read tolerantly, slugs, names, results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.columns import lookup
from matchloom.functions.text import fold, goal_type

# Provider names of teams and what they are called here.
TEAM_ALIASES = {"Türkiye": "Turkey", "Côte d'Ivoire": "Ivory Coast", "Korea Republic": "South Korea", "IR Iran": "Iran", "United States": "USA"}
# Slugs of events that are no goals, and the slug that stands for two cards.
EVENT_SLUGS = {
    "yellow-card": "yellow", "red-card": "red", "substitution": "sub", "kickoff": "kickoff",
    "halftime": "half_time", "half-time": "half_time", "full-time": "full_time", "penalty": "penalty",
}
SECOND_YELLOW, SECOND_YELLOW_DETAIL = "yellow-red-card", "Second yellow card"
# The declared event types, how they are displayed and how important they are.
TAXONOMY = {
    "goal": ("Goal", 1), "own_goal": ("Own goal", 1), "penalty": ("Penalty", 1), "yellow": ("Yellow card", 3), "red": ("Red card", 2),
    "sub": ("Substitution", 4), "kickoff": ("Kickoff", 3), "half_time": ("Half time", 3), "full_time": ("Full time", 2),
}
# Names of team statistics in feeds and here.
STATISTICS = {
    "foulsCommitted": "fouls", "yellowCards": "yellow_cards", "redCards": "red_cards", "possessionPct": "possession",
    "totalShots": "shots", "shotsOnTarget": "shots_on_target", "cornerKicks": "corners", "offsides": "offsides",
}


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """What a JSON value holds at a path, null if there is nothing that can be read so; JSON null is null."""
    found = F.try_variant_get(value, path, kind)
    return F.when(~F.coalesce(F.is_variant_null(found), F.lit(False)), found) if kind == "variant" else found


def listed(value: Column, path: str) -> Column:
    """The list at a path, empty where there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _scalar(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def whole(value: Column) -> Column:
    """A JSON value as an integer: digits in text, fractions cut off, true is 1; lists, objects and other texts are null."""
    text = F.trim(_scalar(value))
    return (
        F.when(_kind(value) == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int")))
        .when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, "$", "double").try_cast("int"))
    )


def number(value: Column) -> Column:
    """A JSON value as a float; lists, objects and texts that are no numbers are null."""
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(
        ~_kind(value).isin("ARRAY", "OBJECT", "VOID"), F.trim(_scalar(value)).try_cast("double")
    )


def scalar_text(value: Column) -> Column:
    """A JSON scalar as text; lists and objects are null."""
    return F.when(_kind(value) == "BOOLEAN", F.initcap(_scalar(value))).when(~_kind(value).isin("ARRAY", "OBJECT", "VOID"), _scalar(value))


def key_text(text: Column) -> Column:
    """Plain decimals without a fraction become integers, of any length; every other key stays as written."""
    digits = F.regexp_extract(text, r"^[+-]?0*([0-9]*)\.0*$", 1)
    collapsed = F.when(digits == "", "0").otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), digits))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.0*|\.0+)$"), collapsed).otherwise(text)


def identifier(value: Column) -> Column:
    """A JSON value as a key: true and false and what is no scalar are none."""
    return F.when(~_kind(value).isin("BOOLEAN", "ARRAY", "OBJECT", "VOID"), key_text(scalar_text(value)))


def feed_id(value: Column) -> Column:
    """The id of a feed's match: a text that is not blank, trimmed, or an integer; anything else is null."""
    text = F.trim(_scalar(value))
    return F.when(_kind(value).isin("STRING", "BIGINT") & (text != ""), text)


def display_name(name: Column) -> Column:
    """A team's name as it is displayed here."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in TEAM_ALIASES.items() for x in pair]), name), name)


def team_key(name: Column) -> Column:
    """What two names of one team have in common."""
    return fold(display_name(name))


def event_type(slug: Column) -> Column:
    """The declared type of a slug: goals and own goals in all their forms, else by name; null for what is not followed."""
    return F.coalesce(goal_type(slug), F.try_element_at(lookup(EVENT_SLUGS.items()), slug))


def importance(kind: Column) -> Column:
    return F.try_element_at(lookup([(k, n) for k, (_, n) in TAXONOMY.items()]), kind)


def round_name(slug: Column) -> Column:
    """A slug as a title: hyphens are spaces, each run of letters begins with a capital."""
    runs = F.regexp_extract_all(F.replace(slug, F.lit("-"), F.lit(" ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    title = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
    return F.when(slug != "", title)


def result_type(description: Column, state: Column) -> Column:
    """How a match was decided: penalties, extra_time or, when over, regulation; null while it is on."""
    told = F.coalesce(description, F.lit(""))
    return F.when(told.contains("Penalt"), "penalties").when(told.contains("Extra Time"), "extra_time").when(state == "post", "regulation")


def pen_score(value: Column) -> Column:
    """A shoot-out score: a whole number of at least 0, as a number; null for anything else."""
    n = F.try_variant_get(value, "$", "double")
    return F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (n >= 0) & (n == F.floor(n)), n.try_cast("int"))


def shootout(home: Column, away: Column) -> Column:
    """{score_pen_home, score_pen_away, pen_winner_side} of two competitors (VARIANT); all null unless both have a score.

    The winner is the one side that is flagged so, whatever the scores say.
    """
    pens = [pen_score(at(x, "$.shootoutScore")) for x in (home, away)]
    both = pens[0].isNotNull() & pens[1].isNotNull()
    won = [F.coalesce(F.try_variant_get(x, "$.winner", "boolean"), F.lit(False)) for x in (home, away)]
    side = F.when(both & won[0] & ~won[1], "home").when(both & won[1] & ~won[0], "away")
    return F.struct(F.when(both, pens[0]).alias("score_pen_home"), F.when(both, pens[1]).alias("score_pen_away"), side.alias("pen_winner_side"))


def qualified_id(source: Column, provider_id: Column) -> Column:
    return F.concat_ws(":", source, provider_id)


def provider_id(source: Column, match_id: Column) -> Column:
    """The provider's own id in a qualified one; any other id as it is."""
    prefix = F.concat(source, F.lit(":"))
    return F.when(match_id.startswith(prefix), F.substring(match_id, F.length(prefix) + 1, F.length(match_id))).otherwise(match_id)


def renamed_scorer(kind: Column, payload: Column) -> Column:
    """Payload of an event as map of JSON texts, the older key ``player`` of goals called ``scorer``."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    texts = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    plain = F.map_from_entries(texts)
    rename = kind.isin("goal", "own_goal") & F.map_contains_key(plain, F.lit("player")) & ~F.map_contains_key(plain, F.lit("scorer"))
    return F.when(rename, F.transform_keys(plain, lambda k, _: F.when(k == "player", "scorer").otherwise(k))).otherwise(plain)


def drift_signature(kind: Column, row: Column) -> Column:
    """One number for a kind of drift and the row it was seen on."""
    return F.xxhash64(kind, F.to_json(row, {"ignoreNullFields": "false"}))
