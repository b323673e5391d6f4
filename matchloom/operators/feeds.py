"""Provider documents to records: scoreboards, summaries, and the rows of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import feed as V
from matchloom.functions.text import city_of, minute_of, possession_of, status_of


def _last_side(competitors: Column, side: str) -> Column:
    """The last competitor of a side, an empty object where there is none."""
    mine = F.filter(competitors, lambda c: V.at(c, "$.homeAway", "string") == side)
    return F.coalesce(F.try_element_at(mine, F.lit(-1)), F.parse_json(F.lit("{}")))


def _venue(venue: Column) -> tuple[Column, Column]:
    filled = lambda x: F.when(x != "", x)
    return filled(V.at(venue, "$.fullName", "string")), city_of(filled(V.at(venue, "$.address.city", "string")))


def _competition(comp: Column) -> dict[str, Column]:
    """What scoreboards and summaries tell alike of a competition."""
    competitors = V.listed(comp, "$.competitors")
    home, away = (_last_side(competitors, s) for s in ("home", "away"))
    clock = F.nullif(V.at(comp, "$.status.displayClock", "string"), F.lit(""))
    description, state = (V.at(comp, f"$.status.type.{n}", "string") for n in ("description", "state"))
    half = lambda c: V.whole(V.at(c, "$.linescores[0].displayValue"))
    return {
        "status": status_of(description, state), "minute": minute_of(clock), "display_clock": clock,
        "score_home": V.whole(V.at(home, "$.score")), "score_away": V.whole(V.at(away, "$.score")),
        "home_team": V.at(home, "$.team.displayName", "string"), "away_team": V.at(away, "$.team.displayName", "string"),
        "score_ht_home": half(home), "score_ht_away": half(away), "shootout": V.shootout(home, away), "result_type": V.result_type(description, state),
    }


SCALARS = ("status", "minute", "display_clock", "score_home", "score_away", "home_team", "away_team", "score_ht_home", "score_ht_away", "result_type")


def _flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *SCALARS, "shootout.*")


def scoreboard_rows(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per event of each scoreboard document (JSON text in ``raw``).

    ``fault`` tells why a row cannot be used: no usable id, or no competition; a
    document that is no JSON, an HTML page among them, gives one row with a fault,
    an empty slate none. Half-time scores are not told on scoreboards.
    """
    v = F.try_parse_json(raw)
    events = F.when(F.schema_of_variant(V.at(v, "$.events")).startswith("ARRAY"), V.listed(v, "$.events"))
    each = documents.select(F.explode(F.coalesce(events, F.array(F.lit(None).cast("variant")))).alias("e"))
    e = F.col("e")
    comp = V.at(e, "$.competitions[0]")
    fault = F.when(e.isNull(), "no scoreboard").when(V.feed_id(V.at(e, "$.id")).isNull(), "no id").when(comp.isNull(), "no competition")
    rows = each.select(
        V.feed_id(V.at(e, "$.id")).alias("match_id"), fault.alias("fault"), F.coalesce(F.nullif(V.at(e, "$.date", "string"), F.lit("")), V.at(e, "$.competitions[0].date", "string")).alias("kickoff_utc"),
        V.round_name(V.at(e, "$.season.slug", "string")).alias("round_name"), *[c.alias(n) for n, c in zip(("stadium", "city"), _venue(V.at(e, "$.competitions[0].venue")), strict=True)],
        *[c.alias(n) for n, c in _competition(comp).items()],
    )
    return _flat(rows, "match_id", "fault", "kickoff_utc", "round_name", "stadium", "city").drop("score_ht_home", "score_ht_away")


def _key_event(e: Column) -> Column:
    """The events that one key event stands for: none, one or two."""
    text = lambda p: V.at(e, p, "string")
    slug = F.coalesce(text("$.type.type"), F.lit(""))
    detail = F.coalesce(F.nullif(text("$.text"), F.lit("")), text("$.shortText"))

    def event(kind: Column, told: Column) -> Column:
        return F.struct(
            minute_of(text("$.clock.displayValue")).alias("minute"), kind.alias("type"), V.importance(kind).alias("importance"), text("$.team.displayName").alias("team"),
            text("$.participants[0].athlete.displayName").alias("player"), text("$.participants[1].athlete.displayName").alias("assist"), told.alias("detail"),
        )

    one = event(V.event_type(slug), detail)
    two = F.array(event(F.lit("yellow"), F.lit(V.SECOND_YELLOW_DETAIL)), event(F.lit("red"), detail))
    return F.when(slug == V.SECOND_YELLOW, two).when(V.event_type(slug).isNotNull(), F.array(one)).otherwise(F.slice(two, 1, 0))


def _statistics(block: Column) -> Column:
    """A team's statistics by name; of a name that comes twice the last counts."""
    names = F.transform(V.listed(block, "$.statistics"), lambda s: F.struct(V.at(s, "$.name", "string").alias("k"), V.at(s, "$.displayValue").alias("v")))

    def value(feed_name: str) -> Column:
        return F.try_element_at(F.filter(names, lambda s: s["k"] == feed_name), F.lit(-1))["v"]

    read = {n: V.whole(value(f)) for f, n in V.STATISTICS.items() if n != "possession"}
    held = F.coalesce(possession_of(V.scalar_text(value("possessionPct"))), V.number(value("possessionPct")))
    return F.struct(V.at(block, "$.team.displayName", "string").alias("team"), held.alias("possession"), *[read[n].alias(n) for n in ("shots", "shots_on_target", "corners", "fouls", "yellow_cards", "red_cards", "offsides")])


def _lineup(block: Column) -> Column:
    """A team's line-up; players without id or name are left out."""
    flag = lambda p, n: F.coalesce(F.try_variant_get(p, f"$.{n}", "boolean"), F.lit(False)).cast("int")
    players = F.filter(V.listed(block, "$.roster"), lambda p: V.at(p, "$.athlete.id").isNotNull() & (F.coalesce(V.at(p, "$.athlete.displayName", "string"), F.lit("")) != ""))
    return F.struct(
        V.at(block, "$.team.displayName", "string").alias("team"), V.at(block, "$.homeAway", "string").alias("home_away"), V.at(block, "$.formation", "string").alias("formation"),
        F.transform(
            players,
            lambda p: F.struct(
                V.scalar_text(V.at(p, "$.athlete.id")).alias("athlete_id"), V.at(p, "$.athlete.displayName", "string").alias("display_name"), V.scalar_text(V.at(p, "$.jersey")).alias("jersey"),
                V.at(p, "$.position.abbreviation", "string").alias("position"), flag(p, "starter").alias("starter"), flag(p, "subbedIn").alias("subbed_in"), flag(p, "subbedOut").alias("subbed_out"),
                V.whole(V.at(p, "$.formationPlace")).alias("formation_place"),
            ),
        ).alias("players"),
    )


def summary_rows(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per summary document (``match_id``, JSON text in ``raw``): the first competition, events, stats, lineups, commentary.

    An event's seq is its position after one key event became two. Nulls at any
    level leave out the part they stand for; a document that is no JSON object
    gives a row with a fault and empty lists.
    """
    v = F.try_parse_json(raw)
    named = lambda blocks, build: F.transform(F.filter(blocks, lambda b: F.coalesce(V.at(b, "$.team.displayName", "string"), F.lit("")) != ""), build)
    comments = F.transform(V.listed(v, "$.commentary"), lambda c: F.trim(V.at(c, "$.text", "string")))
    comp = F.coalesce(V.at(v, "$.header.competitions[0]"), F.parse_json(F.lit("{}")))
    rows = documents.select(
        "match_id", F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no summary").alias("fault"), V.at(v, "$.header.competitions[0].date", "string").alias("kickoff_utc"),
        *[c.alias(n) for n, c in zip(("stadium", "city"), _venue(V.at(v, "$.gameInfo.venue")), strict=True)],
        *[c.alias(n) for n, c in _competition(comp).items()],
        F.flatten(F.transform(V.listed(v, "$.keyEvents"), _key_event)).alias("events"),
        named(V.listed(v, "$.boxscore.teams"), _statistics).alias("stats"), named(V.listed(v, "$.rosters"), _lineup).alias("lineups"),
        F.filter(comments, lambda c: c.isNotNull() & (c != "")).alias("commentary"),
    )
    return _flat(rows, "match_id", "fault", "kickoff_utc", "stadium", "city", "events", "stats", "lineups", "commentary")


def event_rows(summaries: DataFrame) -> DataFrame:
    """Events of summaries as stored rows: seq by position, period null, payload without what is not told.

    The player of a goal or own goal is its scorer.
    """
    each = summaries.select("match_id", F.posexplode("events").alias("seq", "e")).select("match_id", "seq", "e.*")
    goal = F.col("type").isin("goal", "own_goal")
    payload = F.to_json(F.struct("team", F.when(goal, F.col("player")).alias("scorer"), F.when(~goal, F.col("player")).alias("player"), "assist"))
    return each.select("match_id", "seq", "minute", F.lit(None).cast("int").alias("period"), "type", "importance", "detail", payload.alias("payload"))


def _last_by_place(df: DataFrame, keys: list[str], *place: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in place]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("r")).select(*keys, "r.*")


def stat_rows(summaries: DataFrame) -> DataFrame:
    """Statistics of summaries, one row per match and displayed team name, the last one told."""
    each = summaries.select("match_id", F.posexplode("stats").alias("i", "s")).select("match_id", "i", "s.*").withColumn("team", V.display_name(F.col("team")))
    return _last_by_place(each, ["match_id", "team"], "i")


def lineup_rows(summaries: DataFrame) -> DataFrame:
    """Line-ups of summaries, one row per match, displayed team name and athlete key, the last one told."""
    blocks = summaries.select("match_id", F.posexplode("lineups").alias("i", "l"))
    each = blocks.select("match_id", "i", V.display_name(F.col("l.team")).alias("team"), "l.home_away", "l.formation", F.posexplode("l.players").alias("j", "p"))
    flat = each.select("match_id", "i", "j", "team", "home_away", "formation", "p.*").withColumn("athlete_id", V.key_text(F.col("athlete_id"))).where("athlete_id is not null")
    return _last_by_place(flat, ["match_id", "team", "athlete_id"], "i", "j")


def venue_rows(records: DataFrame) -> DataFrame:
    """Venues of records that tell a stadium or a city."""
    return records.where("stadium is not null or city is not null").select("match_id", "stadium", "city")


def roster_rows(teams: DataFrame, squads: DataFrame) -> DataFrame:
    """Players of the squads dimension {name, fifa_code, group, players} for teams(team), joined by team key; a number comes once."""
    keyed = teams.select("team").distinct().withColumn("key", V.team_key(F.col("team")))
    known = squads.select(V.team_key(F.col("name")).alias("key"), "fifa_code", F.col("group").alias("group_name"), F.posexplode("players").alias("i", "p"))
    flat = keyed.join(known, "key").select("team", "fifa_code", "group_name", "i", F.col("p.number").alias("number"), F.col("p.pos").alias("position"), F.col("p.name").alias("player_name"), F.col("p.date_of_birth").alias("date_of_birth"))
    return _last_by_place(flat.where("number is not null and player_name is not null"), ["team", "number"], "i")


def positions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with ``seq``, each row's place among those of its keys, from 0."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)

