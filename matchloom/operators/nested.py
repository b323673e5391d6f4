"""Nested records to flat child tables by Arrow list buffers.

JSON is read once, in the JVM, into typed nested arrays; each Arrow batch of
those is then flattened by list lengths and parent indices, and keys travel by
one vectorised ``take`` per level. No row is looked at in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.columns import let

CHILD = "array<struct<val_a:string,val_b:string>>"
ROWS = "tab string, rec_key string, arr string, i int, j int, val_a string, val_b string"


def child_level(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(elements, index of the parent list, position in it) of a list array; null lists have none."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parents = pc.list_parent_indices(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    count = len(parents)
    positions = pc.subtract(pa.array(range(0), pa.int64()) if not count else pa.arange(0, count), pc.cast(pc.take(starts, parents), pa.int64()))
    return pc.list_flatten(lists), pc.cast(parents, pa.int64()), positions


def _present(elements: pa.Array, *along: pa.Array) -> tuple[pa.Array, ...]:
    keep = elements.is_valid()
    return tuple(x.filter(keep) for x in (elements, *along))


def _rows(tab: str, keys: pa.Array, arr: str, i: pa.Array, j: pa.Array | None, leaf: pa.Array) -> pa.RecordBatch:
    n = len(leaf)
    texts = [pc.fill_null(pc.struct_field(leaf, k).cast(pa.string()), "") for k in ("val_a", "val_b")]
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(tab, n),
            keys.cast(pa.string()),
            pa.repeat(arr, n),
            i.cast(pa.int32()),
            pa.repeat(pa.scalar(-1, pa.int32()), n) if j is None else j.cast(pa.int32()),
            *texts,
        ],
        names=["tab", "rec_key", "arr", "i", "j", "val_a", "val_b"],
    )


def _plain(array):
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def flatten_batch(tab: str, batch: pa.RecordBatch, flat: Iterable[str], deep: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """Child rows of the list columns ``flat`` and of the list-of-list columns ``deep``."""
    keys = _plain(batch.column("rec_key"))
    for name in flat:
        leaf, parent, at = child_level(_plain(batch.column(name)))
        leaf, parent, at = _present(leaf, parent, at)
        yield _rows(tab, keys.take(parent), name, at, None, leaf)
    for name in deep:
        inner, parent, at = child_level(_plain(batch.column(name)))
        leaf, owner, place = child_level(inner)
        leaf, owner, place = _present(leaf, owner, place)
        yield _rows(tab, keys.take(parent.take(owner)), name, at.take(owner), place, leaf)


def flatten(df: DataFrame, tab: str, flat: tuple[str, ...] = (), deep: tuple[str, ...] = ()) -> DataFrame:
    """df(rec_key, lists...) to rows (tab, rec_key, arr, i, j, val_a, val_b), one per non-null element.

    Positions start at 0 and count null elements; j is -1 for a list of one
    level; missing values are ''. Null and empty lists give no rows. Records of
    any length work: a list is never cut, only batches are bounded by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in flatten_batch(tab, batch, flat, deep):
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, ROWS)


# --- JSON into typed lists, JVM side --------------------------------------------------------


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def read_json(text: Column) -> Column:
    """VARIANT of JSON text; JSON text inside a JSON string is read as well; null where unreadable."""
    return let(F.try_parse_json(text), lambda v: F.when(text.rlike(r'^\s*"'), F.try_parse_json(_get(v, "$"))).otherwise(v))


def _listed(v: Column) -> Column:
    home, away = _get(v, "$.home", "variant"), _get(v, "$.away", "variant")
    keyed = F.when(home.isNotNull() | away.isNotNull(), F.array(home, away))
    single = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    return F.coalesce(_get(v, "$", "array<variant>"), keyed, single)


def as_list(v: Column) -> Column:
    """array<variant> of a list; of an object keyed home and away, home before away; of any other single object."""
    inner = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_parse_json(_get(x, "$"))).otherwise(x)
    return let(v, lambda x: F.when(_real(x), let(inner(x), _listed)))


def _real(e: Column) -> Column:
    return e.isNotNull() & ~F.is_variant_null(e)


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_get(v, p) for p in paths])


def _leaf(a: Column, b: Column) -> Column:
    return F.struct(F.coalesce(a, F.lit("")).alias("val_a"), F.coalesce(b, F.lit("")).alias("val_b"))


def _one_of(v: Column, *paths: str) -> Column:
    """The first of the paths that holds something other than null."""
    return F.coalesce(*[let(_get(v, p, "variant"), lambda x: F.when(_real(x), x)) for p in paths])


def _players(lineup: Column) -> Column:
    def leaf(p: Column) -> Column:
        return F.when(_real(p), _leaf(_first(p, "$.display_name", "$.displayName", "$.athlete.displayName", "$.athlete.display_name"), _first(p, "$.athlete_id", "$.athlete.id", "$.id")))

    return F.when(_real(lineup), F.transform(as_list(_one_of(lineup, "$.players", "$.roster")), leaf))


def _teams(team: Column) -> Column:
    return F.when(_real(team), _leaf(F.coalesce(_get(team, "$.team.displayName"), F.when(~_get(team, "$.team").startswith("{"), _get(team, "$.team"))), F.lit("")))


def matches_lists(matches: DataFrame) -> DataFrame:
    """(rec_key, players, stats): line-ups as list of lists, team statistics as a list."""
    read = matches.where("match_id is not null and payload is not null").select(F.col("match_id").alias("rec_key"), read_json(F.col("payload")).alias("v"))
    taken = read.where("v is not null").select(
        "rec_key",
        as_list(_one_of(F.col("v"), "$.lineups", "$.rosters")).alias("lineups"),
        as_list(_one_of(F.col("v"), "$.stats", "$.boxscore.teams")).alias("teams"),
    )
    return taken.where("lineups is not null or teams is not null").select(
        "rec_key", F.transform("lineups", _players).cast(f"array<{CHILD}>").alias("players"), F.transform("teams", _teams).cast(CHILD).alias("stats")
    )


def worldcup_lists(worldcup: DataFrame) -> DataFrame:
    """(rec_key, goals1, goals2) with name and minute as the values."""
    pair = lambda g: F.when(g.isNotNull(), F.struct(g["name"].alias("val_a"), g["minute"].alias("val_b")))
    return worldcup.where("wc_id is not null").select(F.col("wc_id").cast("string").alias("rec_key"), *[F.transform(c, pair).cast(CHILD).alias(c) for c in ("goals1", "goals2")])


def flatten_records(matches: DataFrame, worldcup: DataFrame) -> DataFrame:
    """Distinct child rows of the goal lists and of the line-ups and statistics in the payloads."""
    # Deliveries of the same payload are parsed once each and fall together only as finished rows, which are narrower.
    a = flatten(worldcup_lists(worldcup), "worldcup", flat=("goals1", "goals2"))
    b = flatten(matches_lists(matches), "matches", flat=("stats",), deep=("players",))
    return a.unionByName(b).distinct()
