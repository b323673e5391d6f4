"""Read operations by name, the manifest that tells of them, and a command line made from it."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

from matchloom.functions.feed import TAXONOMY
from matchloom.operators import readport, reads
from matchloom.sources.store import Store

CONTRACT_VERSION = 1
#: Names of the command line's own, which no operation may have.
RESERVED = ("tools",)


class RegistryError(ValueError):
    """Operations of one name, or of a name that is taken."""


@dataclass(frozen=True)
class Param:
    name: str
    kind: type = str
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class Operation:
    """A read: its parameters, and how it gives a DataFrame from a store."""

    name: str
    run: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    about: str = ""


def registry(core: Iterable[Operation], *packs: Iterable[Operation]) -> dict[str, Operation]:
    """Operations by name, core ones first; a name that comes twice is an error."""
    found: dict[str, Operation] = {}
    for operation in (o for group in (core, *packs) for o in group):
        if operation.name in found:
            raise RegistryError(operation.name)
        found[operation.name] = operation
    return found


def usable(core: Iterable[Operation], *packs: Iterable[Operation]) -> dict[str, Operation]:
    """As ``registry`` for a command line: a pack's operation of a taken or reserved name is left out, a core one's is an error."""
    found = registry(core)
    if taken := [n for n in RESERVED if n in found]:
        raise RegistryError(", ".join(taken))
    for group in packs:
        for operation in group:
            if operation.name not in RESERVED:
                found.setdefault(operation.name, operation)
    return found


def manifest(operations: dict[str, Operation]) -> dict:
    """What the operations are and take, as data."""
    listed = [
        {"name": o.name, "about": o.about, "params": [{"name": p.name, "type": p.kind.__name__, "required": p.required, "default": p.default} for p in o.params]}
        for o in operations.values()
    ]
    return {"contract_version": CONTRACT_VERSION, "operations": listed}


def vocabulary(spark: SparkSession) -> DataFrame:
    """The declared event types with display name and importance."""
    return spark.createDataFrame([(k, n, i) for k, (n, i) in TAXONOMY.items()], "type string, display_name string, importance int")


def _vocabulary(store: Store) -> DataFrame:
    return vocabulary(store.spark)


CORE = (
    Operation("matches", lambda s, source=None, status=None: reads.list_matches(s.table("matches"), source, status), (Param("source"), Param("status")), "matches by kick-off and id"),
    Operation("state", lambda s, match_id: readport.side_rows(s.table("matches"), match_id=match_id), (Param("match_id", required=True),), "a match's row"),
    Operation("events", lambda s, match_id, since_seq=-1: reads.events_since(s.table("events"), match_id, since_seq), (Param("match_id", required=True), Param("since_seq", int, default=-1)), "a match's later events"),
    Operation("standings", lambda s, source, group_key=None: reads.standings(s.table("standings"), source, group_key), (Param("source", required=True), Param("group_key")), "standings by stored rank"),
    Operation("vocabulary", _vocabulary, (), "event types"),
)
FOOTBALL = (
    Operation("squad", lambda s, match_id, team=None: readport.lineup(readport.side_rows(s.table("football_lineups"), match_id=match_id), team), (Param("match_id", required=True), Param("team")), "line-ups in order"),
    Operation("player-stats", lambda s, match_id: readport.side_rows(s.table("football_stats"), ("team",), match_id=match_id), (Param("match_id", required=True),), "team statistics"),
)


def discovered(group: str = "matchloom.packs") -> list[tuple[Operation, ...]]:
    """Operations of installed packs; what is no tuple of operations is refused."""
    found = []
    for point in entry_points(group=group):
        pack = point.load()
        if not all(isinstance(o, Operation) for o in pack):
            raise RegistryError(point.name)
        found.append(tuple(pack))
    return found


def store_path(explicit: str | None = None) -> str:
    """Where the store is: as told, as MATCHLOOM_STORE says, or below the home folder."""
    return explicit or os.environ.get("MATCHLOOM_STORE") or os.path.expanduser("~/matchloom")


def parser(operations: dict[str, Operation]) -> argparse.ArgumentParser:
    """Required parameters are positions, the others options; the store and the form of the answer belong to no operation."""
    top = argparse.ArgumentParser(prog="matchloom")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("tools", help="print the manifest")
    for operation in operations.values():
        own = commands.add_parser(operation.name, help=operation.about)
        own.add_argument("--store")
        own.add_argument("--json", action="store_true")
        for p in operation.params:
            own.add_argument(p.name if p.required else f"--{p.name.replace('_', '-')}", type=p.kind, **({} if p.required else {"default": p.default, "dest": p.name}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    operations = usable(CORE, FOOTBALL, *discovered())
    told = parser(operations).parse_args(argv)
    if told.command == "tools":
        print(json.dumps(manifest(operations)))
        return 0
    operation = operations[told.command]
    store = Store.open(spark or SparkSession.builder.getOrCreate(), store_path(told.store))
    rows = operation.run(store, **{p.name: getattr(told, p.name) for p in operation.params})
    # Rows come one partition at a time, however many there are.
    answer = reads.as_json(rows) if told.json else rows
    for row in answer.toLocalIterator():
        print(row[0] if told.json else "\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
