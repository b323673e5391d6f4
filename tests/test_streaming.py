"""Streams end where the batch operators do."""

from pyspark.sql import functions as F

from matchloom.operators.changes import one_per_poll, replay, step
from matchloom.sources import read_table
from matchloom.sources.replay import StepReader, StepReplay
from matchloom.streaming.polls import EVENT_COLUMNS, apply_batch, follow

EVENTS = "source string, match_id string, seq int, minute int, type string, importance int, detail string, payload string"


def event(seq, kind="goal", minute=None):
    return ("s", "m", seq, minute, kind, 1, None, "{}")


def test_drift_over_batches(spark, tmp_path):
    log, drift = str(tmp_path / "log"), str(tmp_path / "drift")
    batches = [[event(1), event(3), event(3)], [event(3), event(2), event(1, "sub"), event(4)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # at least once: a batch may run again
            apply_batch(spark.createDataFrame(rows, EVENTS), n, log, drift)
    assert sorted(r.seq for r in spark.read.parquet(log).collect()) == [1, 3, 4]
    assert sorted((r.seq, r.drift) for r in spark.read.parquet(drift).collect()) == [(1, "conflict"), (2, "retroactive")]


def test_stream_of_polls(spark, folder, tmp_path):
    polls = one_per_poll(read_table(spark, folder, "event_polls"), ["source", "match_id", "seq"])
    for n in (1, 2, 3):
        polls.where(F.col("snapshot_no") == n).select(*EVENT_COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "log"), str(tmp_path / "drift"), str(tmp_path / "check")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == log.select("source", "match_id", "seq").distinct().count() > 0


def test_step_replay(spark, folder):
    first = read_table(spark, folder, "event_polls").orderBy("match_id").first()
    reader = StepReader({"path": f"{folder}/event_polls.parquet", "match_id": first.match_id, "step": "2"})
    rows, offset = reader.read(reader.initialOffset())
    rows = list(rows)
    assert offset == {"revealed": len(rows)} and [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert list(reader.readBetweenOffsets({"revealed": 0}, offset)) == rows
    spark.dataSource.register(StepReplay)
    assert spark.readStream.format("step_replay").option("path", "x").option("match_id", "y").load().isStreaming


def test_reveal(spark):
    events = spark.createDataFrame([event(1, minute=1), event(2), event(3, minute=50), event(4, minute=2)], EVENTS)
    assert sorted(r.seq for r in replay(events, 10.0, 60.0).collect()) == [1, 2]
    assert sorted(r.seq for r in step(events, 3).collect()) == [1, 2, 3]
