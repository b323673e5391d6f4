"""References to records that do not exist, by key-range bitmaps.

Keys are dictionary-encoded: a key falls into a key range by its hash and gets
the next ordinal there. Every (table, column, source, period) owns one
compressed bitmap per key range, kept as its non-empty 64-bit words; parents
own one of the same form. ``reference AND NOT parent`` on the words leaves the
orphans, whose bits are decoded through the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import shuffle_width

#: Key ranges per shuffle partition: keys of a range sort within one task.
RANGES_PER_PARTITION = 4


@dataclass(frozen=True)
class Reference:
    """One referring column. ``scoped``: the parent must be of the same source."""

    tab: str
    col: str
    domain: str
    rows: DataFrame
    scoped: bool
    period_of: str = "collected_at"
    source: str = "source"


@dataclass(frozen=True)
class Parent:
    """The living records of a domain."""

    domain: str
    rows: DataFrame
    key: str
    scoped: bool
    source: str = "source"
    deleted: str = "deleted_at"


def not_blank(column: Column) -> Column:
    """True for text with at least one character that is no white space of any script."""
    return column.isNotNull() & column.rlike(r"(?U)[^\s​﻿]")


def find_orphans(references: list[Reference], parents: list[Parent], ranges: int | None = None) -> DataFrame:
    """Distinct references without a target: (tab, col, source, ref_value, period).

    Null and blank references are none. Repeated rows count once; period is the
    month of the earliest non-null time of all rows with that reference, null if
    there is none. A null source is a source of its own. Empty tables give no
    rows (an empty parent table makes every reference an orphan). Further columns
    of the tables are never read.
    """
    spark = references[0].rows.sparkSession
    ranges = ranges or RANGES_PER_PARTITION * shuffle_width(spark)
    void = F.lit(None).cast("string")

    def of_reference(r: Reference) -> DataFrame:
        ref = F.col(f"`{r.col}`")
        return r.rows.where(not_blank(ref)).select(
            F.lit(r.domain).alias("domain"),
            (F.col(r.source) if r.scoped else void).alias("scope"),
            ref.alias("key"),
            F.lit(r.tab).alias("tab"),
            F.lit(r.col).alias("col"),
            F.col(r.source).alias("source"),
            F.col(r.period_of).cast("timestamp_ntz").alias("at"),
        )

    def of_parent(p: Parent) -> DataFrame:
        return p.rows.where(F.col(p.deleted).isNull() & F.col(p.key).isNotNull()).select(
            F.lit(p.domain).alias("domain"),
            (F.col(p.source) if p.scoped else void).alias("scope"),
            F.col(p.key).alias("key"),
            void.alias("tab"),
            void.alias("col"),
            void.alias("source"),
            F.lit(None).cast("timestamp_ntz").alias("at"),
        )

    parts = [*map(of_reference, references), *map(of_parent, parents)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # Map-side aggregation first: a hot source or key leaves each task as one row per reference.
    keyed = rows.groupBy("domain", "scope", "key", "tab", "col", "source").agg(F.min("at").alias("first_at"))

    in_range = Window.partitionBy("range").orderBy("domain", "scope", "key")
    coded = (
        keyed.withColumn("range", F.pmod(F.xxhash64("domain", "scope", "key"), F.lit(ranges)).cast("int"))
        .withColumn("ordinal", F.dense_rank().over(in_range).cast("long") - 1)
        .select(
            "range",
            "ordinal",
            F.col("key").alias("ref_value"),
            "tab",
            "col",
            "source",
            F.date_format("first_at", "yyyy-MM").alias("period"),
        )
    )

    words = coded.groupBy(
        "range", F.shiftright("ordinal", 6).alias("word"), "tab", "col", "source", "period"
    ).agg(F.expr("bit_or(shiftleft(1L, int(ordinal & 63)))").alias("bits"))
    of_word = Window.partitionBy("range", "word")
    left = (
        words.withColumn("parent", F.coalesce(F.max(F.when(F.col("tab").isNull(), F.col("bits"))).over(of_word), F.lit(0)))
        .where(F.col("tab").isNotNull())
        .withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("parent")))
        .where(F.col("bits") != 0)
    )
    found = left.select(
        "range",
        "tab",
        "col",
        "source",
        "period",
        F.explode(F.expr("transform(filter(sequence(0, 63), b -> (shiftright(bits, b) & 1L) = 1L), b -> word * 64 + b)")).alias("ordinal"),
    )
    dictionary = coded.where(F.col("tab").isNotNull())
    same = ["range", "ordinal", "tab", "col", "period"]
    return (
        found.alias("f")
        .join(
            dictionary.alias("d"),
            [F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}")) if c == "period" else F.col(f"f.{c}") == F.col(f"d.{c}") for c in same]
            + [F.col("f.source").eqNullSafe(F.col("d.source"))],
        )
        .select("d.tab", "d.col", "d.source", "d.ref_value", "d.period")
    )
