"""Recorded matches as JSON documents, one per match: reading with strict checks, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The version of the format and the states a match may be in.
FORMAT_VERSION = 1
STATES = ("SCHEDULED", "IN_PLAY", "PAUSED", "FINISHED", "UNKNOWN")

EVENT = "struct<seq:int,minute:int,event_type:string,importance:int,team:string,player:string,assist:string,detail:string>"
MATCH = "struct<match_id:string,status:string,minute:int,score_home:int,score_away:int,display_clock:string,home_team:string,away_team:string,kickoff_utc:string,payload:string>"
SCHEMA = f"format_version int, match {MATCH}, events array<{EVENT}>"


class RecordingError(ValueError):
    """Recordings that cannot be used."""


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of a file or folder with ``fault``: version, no match, state, seq (null or repeated) or order; null where all is well."""
    seqs = F.transform("events", lambda e: e["seq"])
    fault = (
        F.when(~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION)), "version")
        .when(F.coalesce(F.col("match.match_id"), F.lit("")) == "", "no match")
        .when(~F.coalesce(F.col("match.status").isin(*STATES), F.lit(False)), "state")
        .when(F.exists(seqs, lambda n: n.isNull()) | (F.size(F.array_distinct(seqs)) < F.size(seqs)), "seq")
        .when(F.array_sort(seqs) != seqs, "order")
    )
    return spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("fault", fault)


def read_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(matches, events) of recordings, if none has a fault."""
    rows = recordings(spark, path)
    if bad := rows.where("fault is not null").select("fault", "match.match_id").take(5):
        raise RecordingError(", ".join(f"{r.match_id}: {r.fault}" for r in bad))
    events = rows.select("match.match_id", F.explode("events").alias("e")).select("match_id", "e.*")
    return rows.select("match.*"), events


def stem(match_id: Column) -> Column:
    """A file name for an id: what is no letter, figure, dot, dash or underscore becomes one, and a hash keeps ids apart."""
    return F.concat(F.regexp_replace(match_id, r"[^\p{L}\p{N}_.-]", "_"), F.lit("-"), F.substring(F.sha1(match_id), 1, 8))


def documents(matches: DataFrame, events: DataFrame) -> DataFrame:
    """(match_id, stem, document): each match as one JSON text, its events by seq, nulls kept."""
    names = [c.split(":")[0] for c in MATCH[7:-1].split(",")]
    parts = [c.split(":")[0] for c in EVENT[7:-1].split(",")]
    listed = events.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("events"))
    joined = matches.select("match_id", F.struct(*names).alias("match")).join(listed, "match_id", "left")
    whole = F.struct(F.coalesce("events", F.array().cast(f"array<{EVENT}>")).alias("events"), F.lit(FORMAT_VERSION).alias("format_version"), "match")
    return joined.select("match_id", stem(F.col("match_id")).alias("stem"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


def write_recordings(matches: DataFrame, events: DataFrame, folder: str) -> None:
    """Each match's document as a text file in a folder of its stem."""
    documents(matches, events).select("stem", F.col("document").alias("value")).write.mode("append").partitionBy("stem").text(folder)
