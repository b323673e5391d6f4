"""A streaming source that reveals recorded events, so many per poll or as their minutes come."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "source string, match_id string, seq int, minute int, type string, importance int, detail string, payload string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class StepReader(SimpleDataSourceStreamReader):
    """Offsets count revealed events; each read reveals more in order of seq.

    With ``speed`` those whose game minute has come, speed times as fast as the
    clock, up to the first that has not; else ``step`` more.
    """

    def __init__(self, options: dict[str, str]) -> None:
        table = pq.read_table(options["path"], columns=_COLUMNS, filters=[("match_id", "=", options["match_id"])])
        self.rows = sorted({tuple(r[c] for c in _COLUMNS) for r in table.to_pylist()}, key=lambda r: r[2])
        self.step = int(options.get("step", "1"))
        self.speed = float(options.get("speed", "0"))
        self.clock, self.began = time.monotonic, time.monotonic()

    def _come(self, revealed: int) -> int:
        if self.speed <= 0:
            return min(revealed + self.step, len(self.rows))
        elapsed = (self.clock() - self.began) * self.speed
        while revealed < len(self.rows) and (self.rows[revealed][_COLUMNS.index("minute")] or 0) * 60 <= elapsed:
            revealed += 1
        return revealed

    def initialOffset(self) -> dict[str, int]:
        return {"revealed": 0}

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple], dict[str, int]]:
        end = self._come(start["revealed"])
        return iter(self.rows[start["revealed"] : end]), {"revealed": end}

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple]:
        return iter(self.rows[start["revealed"] : end["revealed"]])


class StepReplay(DataSource):
    """Format ``step_replay`` with options path (a Parquet file), match_id and step or speed: one recorded match."""

    @classmethod
    def name(cls) -> str:
        return "step_replay"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> StepReader:
        return StepReader(self.options)
