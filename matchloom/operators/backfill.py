"""Backfill of finished matches as a batch job over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import date_chunks


def chunks(span: DataFrame, first: str, last: str) -> DataFrame:
    """(day): the days yyyyMMdd to ask for, from the day before to the day after; none if first is after last."""
    return span.select(F.explode(date_chunks(F.col(first), F.col(last))).alias("day")).distinct()


def plan(schedule: DataFrame, days: DataFrame, stored: DataFrame, events: DataFrame) -> DataFrame:
    """Finished matches of the schedule (source, match_id, status, day) on the days, with ``outcome`` skipped or due.

    Skipped are those that the same source has stored with events.
    """
    keys = ["source", "match_id"]
    ended = schedule.where("status = 'FINISHED'").join(days, "day", "left_semi").select(*keys).distinct()
    have = stored.select(*keys).join(events.select(*keys), keys, "left_semi").distinct().withColumn("have", F.lit(True))
    return ended.join(have, keys, "left").select(*keys, F.when(F.col("have"), "skipped").otherwise("due").alias("outcome"))


def apply(planned: DataFrame, details: DataFrame) -> DataFrame:
    """planned with what came of each: applied where a detail without fault came, else failed; the skipped stay.

    One match that fails leaves the others alone; a detail of a foreign source is
    the one fault that stops a job, and shows as ``foreign``.
    """
    keys = ["match_id"]
    came = details.groupBy(*keys).agg(F.min("source").alias("from"), F.max(F.col("fault").isNotNull()).alias("broken"))
    joined = planned.join(came, keys, "left")
    outcome = (
        F.when(F.col("outcome") == "skipped", "skipped").when(F.col("from") != F.col("source"), "foreign").when(F.col("from").isNull() | F.col("broken"), "failed").otherwise("applied")
    )
    return joined.select("source", "match_id", outcome.alias("outcome"))


def tallies(done: DataFrame, by: str = "source") -> DataFrame:
    """Per source how many matches were enumerated, skipped, applied and failed."""
    count = lambda n: F.count_if(F.col("outcome") == n).alias(n)
    return done.groupBy(by).agg(F.count("*").alias("enumerated"), count("skipped"), count("applied"), count("failed"), count("foreign"))


def cursor(events: DataFrame, since: DataFrame) -> DataFrame:
    """Events beyond what each reader has seen: ``since`` has source, match_id and seq; a match without one is read from its start."""
    seen = since.groupBy("source", "match_id").agg(F.max("seq").alias("_seen"))
    return events.join(seen, ["source", "match_id"], "left").where(F.col("seq") > F.coalesce("_seen", F.lit(-1))).drop("_seen")
