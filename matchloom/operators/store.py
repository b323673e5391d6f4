"""What writers of a store may do, as DataFrame operators: guards, appends, upserts, replacements, re-keying.

A table is a change log: each change names the columns it provides and has a
version. Nothing is updated in place; the current rows are an aggregation, and
what must not happen shows as rows with a fault.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import fold
from matchloom.operators.changes import classify_drift
from matchloom.operators.merges import masked_upsert


class ClosedWorldError(ValueError):
    """Columns that a table does not have, or lacks of a row."""


def closed_world(rows: DataFrame, allowed: tuple[str, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """rows, if their columns are among the allowed ones and have the required ones."""
    strange, missing = [c for c in rows.columns if c not in allowed], [c for c in required if c not in rows.columns]
    if strange or missing:
        raise ClosedWorldError(f"unknown columns {strange}, missing columns {missing}")
    return rows


def ownership(rows: DataFrame, matches: DataFrame, writer: str | Column) -> DataFrame:
    """rows with ``fault``: wrong_source, unseeded or cross_partition; null where the writer may write.

    A row names the writer as its source or none; its match must be there
    (``matches``: match_id, source) and belong to the writer.
    """
    writer = F.lit(writer) if isinstance(writer, str) else writer
    owners = matches.groupBy("match_id").agg(F.min("source").alias("owner"))
    fault = F.when(F.col("source") != writer, "wrong_source").when(F.col("owner").isNull(), "unseeded").when(F.col("owner") != writer, "cross_partition")
    return rows.join(owners, "match_id", "left").withColumn("fault", fault).select(*rows.columns, "fault")


def stamped(rows: DataFrame, writer: str) -> DataFrame:
    """rows with the writer as the source of those that name none."""
    return rows.withColumn("source", F.coalesce("source", F.lit(writer)) if "source" in rows.columns else F.lit(writer))


def append_events(stored: DataFrame, batch: DataFrame, matches: DataFrame, arrival: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """batch with ``drift``, ``fault`` (of the row) and ``refused`` (whether its match's whole batch is).

    All rows of a match stand or fall together. Faults are those of ownership, a
    seq that is null or not above the one that arrived before, a type that is not
    declared, a stored seq with other values, and an unknown seq below the head.
    What is to be written is new and not refused; resent rows are none of it.
    """
    keys = ["source", "match_id"]
    before = F.lag("seq").over(Window.partitionBy(*keys).orderBy(arrival))
    kept = batch.withColumn("before", before)
    owned = ownership(classify_drift(stored, kept, arrival), matches, F.col("source"))
    undeclared = F.lit(False) if types is None else ~F.coalesce(F.col("type").isin(*types), F.lit(False))
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("seq").isNull(), "malformed")
        .when(undeclared, "undeclared")
        .when(F.col("seq") <= F.col("before"), "not_increasing")
        .when(F.col("drift").isin("conflict", "retroactive"), F.col("drift"))
    )
    judged = owned.withColumn("fault", fault).drop("before")
    return judged.withColumn("refused", F.max(F.col("fault").isNotNull()).over(Window.partitionBy(*keys)))


def entity_faults(rows: DataFrame) -> DataFrame:
    """rows with their fold stamped and ``fault``: incomplete (no kind or name), or stale (another fold supplied)."""
    stamped_fold = fold("display_name")
    supplied = F.col("name_folded") if "name_folded" in rows.columns else F.lit(None).cast("string")
    fault = F.when(F.col("kind").isNull() | F.col("display_name").isNull(), "incomplete").when(supplied != stamped_fold, "stale")
    return rows.withColumns({"fault": fault, "name_folded": stamped_fold})


def upsert_entities(log: DataFrame, version: str) -> DataFrame:
    """Current entities of a log of whole rows, each with its own fold; rows without kind or name are not written."""
    good = entity_faults(log.drop("name_folded")).where("fault is null").drop("fault")
    rest = [c for c in good.columns if c not in ("source", "entity_id")]
    return good.groupBy("source", "entity_id").agg(F.max_by(F.struct(*rest), version).alias("r")).select("source", "entity_id", "r.*")


def upsert_standings(log: DataFrame, version: str) -> DataFrame:
    """Current standings of a change log with ``provided``, by (source, group_key, entity_id)."""
    return masked_upsert(log, ["source", "group_key", "entity_id"], version, [c for c in ("points", "rank", "payload") if c in log.columns])


def provider_map(log: DataFrame, version: str) -> DataFrame:
    """Current (source, provider, provider_match_id, match_id) of a log with ``deleted``: the last entry, unless it deletes."""
    last = log.groupBy("source", "provider", "provider_match_id").agg(F.max_by(F.struct("match_id", "deleted"), version).alias("r"))
    return last.where("not r.deleted").select("source", "provider", "provider_match_id", "r.match_id")


def forbidden_entries(entries: DataFrame) -> DataFrame:
    """Entries that lead to a stub of their own id, which are never kept."""
    return entries.where(F.col("match_id") == F.concat_ws(":", "source", "provider_match_id"))


def reverse_map(entries: DataFrame) -> DataFrame:
    """Per (source, match_id) its provider ids in order, the first of them, and whether there are several."""
    listed = entries.groupBy("source", "match_id").agg(F.array_sort(F.collect_set(F.struct("provider", "provider_match_id"))).alias("ids"))
    return listed.select("source", "match_id", "ids", F.col("ids")[0]["provider_match_id"].alias("first"), (F.size("ids") > 1).alias("several"))


def changed_slices(stored: DataFrame, desired: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Slices of the desired rows whose stored rows are others, repeats counted; one aggregation of both."""
    names = desired.columns
    signed = stored.select(*names, F.lit(1).alias("_n")).unionByName(desired.select(*names, F.lit(-1).alias("_n")))
    other = signed.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0").select(*slice_keys).distinct()
    return other.join(desired.select(*slice_keys).distinct(), slice_keys, "left_semi")


def replace_if_changed(stored: DataFrame, desired: DataFrame, slice_keys: list[str]) -> DataFrame:
    """stored with the changed slices as desired; slices that are not desired stay."""
    changed = changed_slices(stored, desired, slice_keys)
    return stored.join(changed, slice_keys, "left_anti").select(*stored.columns).unionByName(desired.join(changed, slice_keys, "left_semi").select(*stored.columns))


def insert_once(stored: DataFrame, incoming: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """Rows of groups that are not stored yet, of each key the first by ``order``."""
    rest = [c for c in incoming.columns if c not in (group, key)]
    fresh = incoming.join(stored.select(group).distinct(), group, "left_anti")
    return fresh.groupBy(group, key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(group, key, "r.*")


def adoptable(adoption: DataFrame, events: DataFrame) -> DataFrame:
    """adoption (source, stub_id, canonical_id) with ``refused``: whether both have events, two histories that are not mixed."""
    counts = events.groupBy("source", "match_id").agg(F.count("*").alias("n"))
    of = lambda name: counts.select("source", F.col("match_id").alias(name), F.col("n").alias(f"n_{name}"))
    joined = adoption.join(of("stub_id"), ["source", "stub_id"], "left").join(of("canonical_id"), ["source", "canonical_id"], "left")
    return joined.select(*adoption.columns, (F.col("n_stub_id").isNotNull() & F.col("n_canonical_id").isNotNull()).alias("refused"))


def rekey(rows: DataFrame, adoption: DataFrame, keys: list[str]) -> DataFrame:
    """rows with stubs' match_id made canonical; of equal ``keys`` then the row that came from a stub stays."""
    to = adoption.select("source", F.col("stub_id").alias("match_id"), "canonical_id")
    moved = rows.join(to, ["source", "match_id"], "left").withColumn("_stub", F.col("canonical_id").isNotNull()).withColumn("match_id", F.coalesce("canonical_id", "match_id")).drop("canonical_id")
    rest = [c for c in rows.columns if c not in keys]
    return moved.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_stub")).alias("r")).select(*keys, "r.*")
