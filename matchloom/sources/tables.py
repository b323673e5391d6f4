"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.store import exists


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``, one Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_present(rows: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the named columns that rows have and that is not null; a typed null where they have none."""
    have = [F.col(n).cast(kind) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON dimension, which is small; none where the file is not there."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def imported_squads(lineups: DataFrame | None, rosters: DataFrame) -> DataFrame:
    """Squads (team, athlete_id, display_name, jersey, position) of either shape of an older store: line-ups where it has them, else rosters."""
    rows = rosters if lineups is None else lineups
    return rows.select(
        "team", first_present(rows, "athlete_id").alias("athlete_id"), first_present(rows, "display_name", "player_name").alias("display_name"),
        first_present(rows, "jersey", "number").alias("jersey"), first_present(rows, "position").alias("position"),
    ).distinct()
