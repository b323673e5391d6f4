"""Polls as a stream: each micro-batch is classified against the log and its new events are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from matchloom.operators.changes import classify_drift
from matchloom.sources.store import exists

#: Parts of the log by match: a batch reads the parts of its own matches only.
BUCKETS = 64
EVENT_COLUMNS = ("source", "match_id", "seq", "minute", "type", "importance", "detail", "payload")


def stored_events(spark: SparkSession, log: str, schema, before: int | None = None) -> DataFrame:
    """The event log up to a batch, so that a batch that runs again never meets its own rows; empty where nothing is stored yet."""
    if not exists(spark, log):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("bucket", IntegerType())]))
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])).parquet(log)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.select(*[f.name for f in schema.fields], "bucket")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.hash("source", "match_id"), F.lit(BUCKETS)))


def apply_batch(batch: DataFrame, batch_id: int, log: str, drift: str) -> None:
    """Append what is new, write down what drifted. Running a batch id again rewrites the same two folders."""
    rows = batch.select(*EVENT_COLUMNS)
    # The join on the bucket prunes the log's folders to those of the polled matches.
    polled = _bucketed(rows.select("source", "match_id").distinct())
    stored = stored_events(batch.sparkSession, log, rows.schema, before=batch_id).join(polled, ["bucket", "source", "match_id"], "left_semi").drop("bucket")
    classified = classify_drift(stored, rows).persist()
    try:
        _bucketed(classified.where("drift = 'new'").drop("drift")).write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch={batch_id}")
        classified.where("drift in ('conflict', 'retroactive')").write.mode("overwrite").parquet(f"{drift}/batch={batch_id}")
    finally:
        classified.unpersist()


def follow(events: DataFrame, log: str, drift: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream of polled events into the log; a re-sent event is no event, a late one never gets in."""
    return (
        events.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, log, drift))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
