"""What changed between full snapshots, by presence bitmaps and value vectors.

Keys get ordinals; each snapshot of a source becomes one bitmap over them and
one vector of value codes aligned with it. Of two successive snapshots, AND-NOT
gives additions and removals, and comparing the vectors on the common bits
gives changes. Key blocks are independent, and so are runs of snapshots that
share the one between them, so that a source of any size and history spreads
over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import shuffle_width

#: Snapshots of a block that one task holds.
RUN = 64

CHANGES = "tab string, source string, snapshot_no int, match_id string, seq int, change string"


def _codes(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """One integer per row, equal where all columns are; null is a value of its own."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        own = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode")
        code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    return code


def block_changes(table: pa.Table) -> pa.Table:
    """Changes of one block: one row per key and snapshot comes in, one per change goes out."""
    key, value = _codes(table, ("match_id", "seq")), _codes(table, ("value",))
    at = table["at"].to_numpy()
    n = int(key.max()) + 1 if len(key) else 0
    sample = np.zeros(n, np.int64)
    sample[key] = np.arange(len(key))
    order = np.argsort(at, kind="stable")
    steps = range(int(at.min()), int(at.max()) + 2) if len(at) else range(0)
    bounds = np.searchsorted(at[order], np.array([*steps, len(steps) + (steps.start if len(at) else 0)]))
    # A snapshot that holds no key of this block is known by its predecessor's next_no.
    number = {a + 1: s for a, s in zip(at.tolist(), table["next_no"].to_pylist(), strict=True) if s is not None}
    number |= dict(zip(at.tolist(), table["snapshot_no"].to_pylist(), strict=True))
    hits: list[tuple[np.ndarray, int, str]] = []
    before, old = np.zeros((n + 7) // 8, np.uint8), np.zeros(n, np.int64)
    for k, step in enumerate(steps):
        if step not in number:  # no key of this block here, nor in the snapshot before
            continue
        rows = order[bounds[k] : bounds[k + 1]]
        present, new = np.zeros(n, bool), np.zeros(n, np.int64)
        present[key[rows]] = True
        new[key[rows]] = value[rows]
        bits = np.packbits(present)
        if step:
            for kind, words in (("added", bits & ~before), ("removed", before & ~bits)):
                hits.append((np.flatnonzero(np.unpackbits(words, count=n)), number[step], kind))
            common = np.flatnonzero(np.unpackbits(bits & before, count=n))
            hits.append((common[new[common] != old[common]], number[step], "changed"))
        before, old = bits, new
    rows = np.concatenate([sample[h] for h, _, _ in hits]) if hits else np.zeros(0, np.int64)
    base = table.select(["tab", "source", "match_id", "seq"]).take(pa.array(rows))
    numbers = pa.array(np.concatenate([np.full(len(h), s) for h, s, _ in hits]) if hits else [], pa.int32())
    kinds = pa.array([kind for h, _, kind in hits for _ in range(len(h))], pa.string())
    return pa.table([base["tab"], base["source"], numbers, base["match_id"], base["seq"], kinds], names=["tab", "source", "snapshot_no", "match_id", "seq", "change"])


def snapshot_changes(tables: dict[str, tuple[DataFrame, bool, tuple[str, ...]]], blocks: int | None = None) -> DataFrame:
    """Distinct (tab, source, snapshot_no, match_id, seq, change) of all tables.

    ``tables``: name to (rows, whether seq is part of the key, value columns).
    Of a key that occurs twice in one snapshot the latest polled_at counts, of
    equal times the greatest values; null is a value of its own, in keys too.
    Compared are successive snapshots that the source has rows for; its first
    gives no rows. Rows without snapshot_no are left out: they belong to none.
    """
    parts = []
    for tab, (rows, has_seq, values) in tables.items():
        parts.append(
            rows.where("snapshot_no is not null").select(
                F.lit(tab).alias("tab"),
                "source",
                "snapshot_no",
                "match_id",
                (F.col("seq") if has_seq else F.lit(-1)).cast("int").alias("seq"),
                F.struct("polled_at", F.to_json(F.struct(*[F.col(v).cast("string").alias(v) for v in values])).alias("value")).alias("row"),
            )
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    spark = every.sparkSession
    blocks = blocks or shuffle_width(spark)
    latest = every.groupBy("tab", "source", "snapshot_no", "match_id", "seq").agg(F.max("row")["value"].alias("value"))
    # One row per source and snapshot: the order of a source's snapshots.
    in_order = Window.partitionBy("tab", "source").orderBy("snapshot_no")
    slates = (
        every.select("tab", "source", "snapshot_no")
        .distinct()
        .withColumns({"at": F.row_number().over(in_order) - 1, "next_no": F.lead("snapshot_no").over(in_order)})
        .withColumnsRenamed({"tab": "t", "source": "s", "snapshot_no": "n"})
    )
    placed = latest.join(slates, (F.col("tab") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("snapshot_no") == F.col("n"))).select(
        "tab", "source", "snapshot_no", "match_id", "seq", "value", "at", "next_no", F.pmod(F.xxhash64("match_id", "seq"), F.lit(blocks)).alias("block")
    )
    # A run's last snapshot is the next run's first, which changes are counted from; what follows it is known there.
    run, last = F.floor(F.col("at") / RUN), F.col("at") % RUN == RUN - 1
    dealt = placed.withColumn("run", F.explode(F.when(last, F.array(run, run + 1)).otherwise(F.array(run))))
    own_end = last & (F.col("run") == run)
    local = dealt.withColumns({"next_no": F.when(~own_end, F.col("next_no")), "at": F.when(F.col("run") > 0, F.col("at") - F.col("run") * RUN + 1).otherwise(F.col("at")).cast("int")})
    return local.groupBy("tab", "source", "block", "run").applyInArrow(block_changes, CHANGES)
