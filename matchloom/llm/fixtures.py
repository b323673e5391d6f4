"""Matching fixtures across providers without keys: BM25 retrieval, mutual nearest, calibrated confidence.

Every match is a bag of attribute terms. Essential ones say who plays when: a
team near a day or, where a row tells no day, the pair of teams (one team where
the other is not told). Light ones are hour, ground and scores; rounds are
numbered by each provider on its own and tell nothing. Terms weigh by BM25 over
all rows. What a row's light terms can add up to bounds the score of every
partner without an essential term in common; only partners above that bound
count, so the posting lists of the essential terms hold all that do, and the
long lists of the light terms are never walked, only added up on what the
essential ones brought. The best partner in each other provider counts where the
choice is mutual, and its lead over the next best, or over the bound, becomes a
confidence.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.identities import name_teams
from matchloom.operators.instants import moments_of_matches, payload_text
from matchloom.operators.nested import read_json
from matchloom.session import cut_lineage

#: BM25's parameters; every term occurs once.
K1, B = 1.2, 0.4
#: Kick-offs further apart than this are another occasion.
SAME_OCCASION_H = 12
#: Of a date without time of day the zone is not known either: dates further apart than this are another occasion.
SAME_DATE_DAYS = 1
#: A row without kick-off is near a fixture if both were first delivered within so many days.
SAME_DELIVERY_DAYS = 3
#: Within so many days a row without kick-off needs the same ground, score and half-time score.
LATE_DAYS = 60

#: Least confidence of a pair.
CONFIDENT = 0.5

#: Attributes whose agreement is weighed, beside the two teams and the day.
LIGHT = ("hour", "ground", "score", "half_score")


def fixture_records(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per (source, match_id): team_a <= team_b, instant, day (of the instant, else the stated date), and the light attributes."""
    rows = matches.where("match_id is not null and source is not null")
    latest = rows.groupBy("source", "match_id").agg(
        F.max_by(
            F.struct("kickoff_utc", "home_entity", "away_entity", "score_home", "score_away", "payload"), F.struct(F.coalesce("updated_at", F.lit("")), "collected_at", F.coalesce("payload", F.lit("")))
        ).alias("m"),
        F.min("collected_at").alias("collected"),
    )
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    flat = latest.select("source", "match_id", "m.*", "collected").withColumn("v", read_json(F.col("payload")))
    read = flat.select(
        "source", "match_id", "kickoff_utc", "home_entity", "away_entity", "score_home", "score_away", F.col("collected").cast("timestamp_ntz").alias("collected"),
        F.coalesce(text("$.home_team"), text("$.lineups[0].team"), text("$.rosters[0].team.displayName"), text("$.lineups.home.team")).alias("home_text"),
        F.coalesce(text("$.away_team"), text("$.lineups[1].team"), text("$.rosters[1].team.displayName"), text("$.lineups.away.team")).alias("away_text"),
        text("$.stadium").alias("ground"), payload_text(F.col("payload"), "$.venue_tz").alias("tz"),
        F.try_variant_get(v, "$.score_ht_home", "int").alias("ht_home"), F.try_variant_get(v, "$.score_ht_away", "int").alias("ht_away"),
    )
    read = cut_lineage(moments_of_matches(read, F.col("tz")).drop("kickoff_utc", "tz"))
    texts = read.select(F.explode(F.array("home_text", "away_text")).alias("text")).where("text is not null").distinct()
    of_entity, of_text = name_teams(entities, texts)
    joined = read
    for side in ("home", "away"):
        e = of_entity.select(F.col("source").alias(f"{side}_s"), F.col("entity_id").alias(f"{side}_e"), F.col("team").alias(f"{side}_by_id"))
        t = of_text.select(F.col("text").alias(f"{side}_t"), F.col("team").alias(f"{side}_by_text"))
        joined = joined.join(e, (F.col("source") == F.col(f"{side}_s")) & (F.col(f"{side}_entity") == F.col(f"{side}_e")), "left")
        joined = joined.join(t, F.col(f"{side}_text") == F.col(f"{side}_t"), "left")
        joined = joined.withColumn(side, F.coalesce(f"{side}_by_id", f"{side}_by_text"))
    pair = lambda a, b: F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), pair(F.col(a), F.col(b)))
    return joined.select(
        "source", "match_id", "instant", "collected", F.coalesce(F.date_format("instant", "yyyy-MM-dd"), F.col("stated").cast("string")).alias("day"),
        F.least("home", "away").alias("team_a"), F.when(F.col("home").isNotNull() & F.col("away").isNotNull(), F.greatest("home", "away")).alias("team_b"),
        F.date_format(F.col("instant") + F.expr("interval 30 minutes"), "HH").alias("hour"), F.lower(F.trim("ground")).alias("ground"),
        both("score_home", "score_away").alias("score"), both("ht_home", "ht_away").alias("half_score"),
    )


def _weights(records: DataFrame) -> DataFrame:
    """records with ``w``, the inverse document frequency of each attribute's value, ``norm``, BM25's length factor, and ``bound``."""
    attributes = ["team_a", "team_b", "day", *LIGHT]
    terms = records.select("source", "match_id", F.explode(F.array(*[F.struct(F.lit("team" if c.startswith("team") else c).alias("attr"), F.lit(c).alias("slot"), F.col(c).alias("value")) for c in attributes])).alias("t")).select(
        "source", "match_id", "t.*"
    )
    terms = terms.where("value is not null")
    totals = records.agg(F.count("*").alias("n"), F.avg(sum(F.col(c).isNotNull().cast("int") for c in attributes)).alias("mean")).first()
    counts = terms.groupBy("attr", "value").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(totals.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm_of = lambda n: K1 * (1 - B + B * n / F.lit(totals["mean"] or 1.0))
    # The most that a partner without an essential term can get: it has j of the light terms at best, and so as many terms at least.
    light = F.sort_array(F.collect_list(F.when(F.col("slot").isin(*LIGHT), idf)), asc=False)
    best = [F.aggregate(F.slice(light, 1, j), F.lit(0.0), lambda x, y: x + y) * (K1 + 1) / (1 + norm_of(j)) for j in range(1, len(LIGHT) + 1)]
    weighed = terms.join(counts, ["attr", "value"]).groupBy("source", "match_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", idf.alias("idf")))).alias("w"),
        norm_of(F.count("*")).alias("norm"), F.greatest(*best).alias("bound"),
    )
    return records.join(weighed, ["source", "match_id"])


def _candidates(records: DataFrame) -> DataFrame:
    """Distinct (a, b) of different providers, a's before b's, that share an essential term."""
    key = F.struct("source", "match_id")
    dated, undated = records.where("day is not null"), records.where("day is null")
    subjects = F.explode(F.array_compact(F.array("team_a", "team_b")))
    index = dated.select(key.alias("b"), subjects.alias("team"), "day")
    probe = dated.select(key.alias("a"), subjects.alias("team"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.date_add(F.col("day").cast("date"), k).cast("string"))).alias("day"))
    by_day = probe.join(index, ["team", "day"]).select("a", "b")
    # A row without a day looks for its pair of teams among all rows.
    lost = undated.where("team_b is not null").select(key.alias("a"), "team_a", "team_b")
    every = records.where("team_b is not null").select(key.alias("b"), "team_a", "team_b")
    by_pair = lost.join(every, ["team_a", "team_b"]).select("a", "b")
    # Where either tells one team only, that team's list stands for the pair's.
    told = lambda df, n: df.select(key.alias(n), subjects.alias("team"), F.col("team_b").isNull().alias(f"half_{n}"))
    by_team = told(undated, "a").join(told(records, "b"), "team").where("half_a or half_b").select("a", "b")
    ordered = by_day.unionByName(by_pair).unionByName(by_team).where("a.source <> b.source")
    swap = F.col("a.source") > F.col("b.source")
    return ordered.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def _scored(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) with what they share, their BM25 scores in both directions and the bounds of both."""
    fields = [c for c in records.columns if c not in ("source", "match_id")]
    side = lambda n: records.select(F.struct("source", "match_id").alias(n), F.struct(*fields).alias(f"{n}_r"))
    pairs = candidates.join(side("a"), "a").join(side("b"), "b")
    a, b = (lambda c: F.col("a_r")[c]), (lambda c: F.col("b_r")[c])
    weight = lambda c: F.coalesce(F.try_element_at(a("w"), F.lit(c)), F.lit(0.0))
    hours = F.abs(F.timestamp_diff("MINUTE", a("instant"), b("instant"))) / 60.0
    delivered = F.abs(F.timestamp_diff("HOUR", a("collected"), b("collected"))) / 24.0
    days = F.abs(F.datediff(a("day").cast("date"), b("day").cast("date")))
    near = F.when(hours.isNotNull(), hours <= SAME_OCCASION_H).when(days.isNotNull(), days <= SAME_DATE_DAYS).otherwise(delivered <= SAME_DELIVERY_DAYS)
    in_b = lambda c: F.coalesce((a(c) == b("team_a")) | (a(c) == b("team_b")), F.lit(False)) & a(c).isNotNull()
    shared = F.when(in_b("team_a"), weight("team_a")).otherwise(0.0) + F.when(in_b("team_b"), weight("team_b")).otherwise(0.0)
    # Teams count with their day; without one the pair counts, or one team where another is not told.
    told = a("team_b").isNotNull() & b("team_b").isNotNull()
    essential = F.when(days.isNotNull(), near & (days <= SAME_DATE_DAYS)).otherwise((in_b("team_a") & in_b("team_b")) | ~told)
    shared = F.when(essential, shared).otherwise(0.0)
    day = F.when(near & essential & (in_b("team_a") | in_b("team_b")), F.greatest(weight("day"), F.coalesce(F.try_element_at(b("w"), F.lit("day")), F.lit(0.0))))
    light = [F.when(a(c) == b(c), weight(c)).otherwise(0.0) for c in LIGHT]
    total = sum(light, shared + F.coalesce(day, F.lit(0.0)))
    return pairs.select(
        "a", "b", hours.alias("hours"), days.alias("days"), delivered.alias("delivered"), a("bound").alias("a_bound"), b("bound").alias("b_bound"),
        (in_b("team_a").cast("int") + in_b("team_b").cast("int")).alias("teams"),
        (a("team_b").isNotNull() & b("team_b").isNotNull()).alias("both_known"),
        *[F.when(a(c).isNotNull() & b(c).isNotNull(), a(c) == b(c)).alias(f"same_{c}") for c in LIGHT],
        (total * (K1 + 1) / (1 + b("norm"))).alias("a_to_b"), (total * (K1 + 1) / (1 + a("norm"))).alias("b_to_a"),
    )


def _best(scored: DataFrame, me: str, other: str, score: str) -> DataFrame:
    """The best partner above the bound of each row in each other provider, with its lead over the next best or the bound."""
    scored = scored.where(F.col(score) > F.col(f"{me}_bound"))
    ranked = Window.partitionBy(me, F.col(f"{other}.source")).orderBy(F.desc(score), F.col(f"{other}.match_id"))
    return (
        scored.withColumns({"rank": F.row_number().over(ranked), "next": F.lead(score).over(ranked)})
        .where("rank = 1")
        .select("a", "b", (F.col(score) - F.coalesce("next", f"{me}_bound")).alias(f"{me}_lead"))
    )


def fit_logistic(gaps: list[tuple[float, int, int]], rounds: int = 25) -> tuple[float, float]:
    """(intercept, slope) of the share of hits by lead, from counts (lead, rows, hits)."""
    x = np.array([[1.0, g] for g, _, _ in gaps] or [[1.0, 0.0]])
    n, y = np.array([r for _, r, _ in gaps] or [1.0]), np.array([h for _, _, h in gaps] or [0.5])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(step, x.T @ (y - n * p) - 1e-3 * w), -2, 2)
    return float(w[0]), float(w[1])


class Calibration(NamedTuple):
    """Chance of a hit by lead, the share of hits where the lead is great, and the mean squared error on what it was not fitted on."""

    base: float
    slope: float
    ceiling: float
    brier: float


def calibrate(bins: list[tuple[int, float, int, int]]) -> Calibration:
    """From counts (half, lead, rows, hits): fitted on half 0, measured on half 1.

    A hit is a sign of a match that not every match shows: how many do is told by
    the pairs of the upper half of leads, which are matches as good as surely.
    """
    fit = [(g, n, h) for half, g, n, h in bins if half == 0]
    base, slope = fit_logistic(fit)
    leads = sorted((g, n) for g, n, _ in fit)
    middle = next((g for k, (g, _) in enumerate(leads) if 2 * sum(n for _, n in leads[: k + 1]) >= sum(n for _, n in leads)), 0.0)
    upper = [(n, h) for g, n, h in fit if g >= middle]
    ceiling = sum(h for _, h in upper) / sum(n for n, _ in upper) if upper else 1.0
    error = rows = 0.0
    for half, g, n, h in bins:
        if half:
            p = 1 / (1 + np.exp(-(base + slope * g)))
            error, rows = error + h * (1 - p) ** 2 + (n - h) * p**2, rows + n
    return Calibration(base, slope, ceiling or 1.0, float(error / rows) if rows else 0.0)


def match_fixtures(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """(match_id_a, match_id_b, confidence): the pairs that are one fixture, smaller id first.

    Kept are mutual best partners of a confidence of at least CONFIDENT that pass the exact check: the same two teams
    (one of them where the other is not told), and kick-offs of one occasion,
    dates next to each other where one states no time of day or, where one states
    no date either, deliveries of one occasion. Null and blank entities are told by the payload if it can be;
    repeated deliveries count once, the latest one; withdrawn rows count.
    """
    records = cut_lineage(_weights(cut_lineage(fixture_records(matches, entities))))
    scored = cut_lineage(_scored(records, _candidates(records)))
    mutual = cut_lineage(_best(scored, "a", "b", "a_to_b").join(_best(scored, "b", "a", "b_to_a"), ["a", "b"]).join(scored, ["a", "b"]).withColumn("lead", F.least("a_lead", "b_lead")))
    # Calibration: how often both were first delivered together, which no score looks at, by lead in steps of a half.
    step = F.greatest(F.least(F.round(F.col("lead") * 2) / 2, F.lit(60.0)), F.lit(0.0))
    agreed = mutual.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(2)).alias("half"), step.alias("g")).agg(F.count("*").alias("n"), F.sum((F.col("delivered") <= SAME_DELIVERY_DAYS).cast("long")).alias("h"))
    fitted = calibrate([(r.half, r.g, r.n, r.h) for r in agreed.collect()])
    chance = 1 / (1 + F.exp(-(F.lit(fitted.base) + F.lit(fitted.slope) * F.col("lead"))))
    confidence = F.least(F.lit(1.0), chance / F.lit(fitted.ceiling))
    alike = lambda c: F.coalesce(F.col(f"same_{c}"), F.lit(False))
    unlike = lambda c: ~F.coalesce(F.col(f"same_{c}"), F.lit(True))
    teams = F.when(F.col("both_known"), F.col("teams") == 2).otherwise((F.col("teams") >= 1) & (alike("ground") | alike("score")))
    late = (F.col("delivered") <= LATE_DAYS) & alike("ground") & alike("score") & alike("half_score")
    undated = (F.col("delivered") <= SAME_DELIVERY_DAYS) & ~unlike("ground") | late
    occasion = F.when(F.col("hours").isNotNull(), F.col("hours") <= SAME_OCCASION_H).when(F.col("days").isNotNull(), F.col("days") <= SAME_DATE_DAYS).otherwise(undated)
    kept = mutual.where(teams & occasion & (confidence >= CONFIDENT)).select(
        F.least("a.match_id", "b.match_id").alias("match_id_a"), F.greatest("a.match_id", "b.match_id").alias("match_id_b"), confidence.alias("confidence")
    )
    return kept.groupBy("match_id_a", "match_id_b").agg(F.max("confidence").alias("confidence"))
