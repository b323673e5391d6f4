"""Exact radius joins of words by metric-space partitioning.

Pivots part the space: an indexed word belongs to the cell of its nearest
pivot; a probe is replicated to every cell that, by the triangle inequality,
can hold a word within the radius (distance to the cell's pivot at most its
least pivot distance plus twice the radius). Inside a cell lengths, pivot
distances and letter counts bound the distance from below, and what they leave
is measured by the edit distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import shuffle_width

#: Pivots of a join: what is sent to the tasks is bounded by this.
PIVOTS = 48
#: Words of a cell that one task holds.
CELL_WORDS = 20_000
#: Letters of a word that are counted.
COUNTED = 100


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance (a metric)."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def shortened(word: str) -> list[str]:
    """The word and all that one deletion makes of it."""
    return [word] + [word[:i] + word[i + 1 :] for i in range(len(word))]


def slip(a: str, b: str) -> int:
    """Edits between two words where swapping two neighbouring letters is one edit; 3 stands for more than two."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    d = edit_distance(a, b)
    if d == 2 and len(a) == len(b):
        k = next(i for i in range(len(a)) if a[i] != b[i])
        if a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]:
            return 1
    return min(d, 3)


#: Letters of words that are laid out side by side at once.
LAID_OUT = 4_000_000


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, length of each)."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


def pivot_table(words: list[str], pivots: list[str]) -> np.ndarray:
    """Levenshtein distance of every word to every pivot; words of like length are measured together."""
    out = np.zeros((len(words), len(pivots)), np.int32)
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high - low + 1) * (len(words[order[high]]) + 1) <= LAID_OUT:
            high += 1
        part = order[low:high]
        out[part] = _measured([words[k] for k in part], pivots)
        low = high
    return out


def _measured(words: list[str], pivots: list[str]) -> np.ndarray:
    flat, size = _letters(words)
    width = int(size.max())
    letters = np.zeros((len(words), width), np.uint32)
    letters[np.arange(width) < size[:, None]] = flat
    out = np.empty((len(words), len(pivots)), np.int32)
    place = np.arange(width + 1, dtype=np.int32)
    for n, pivot in enumerate(pivots):
        # One row per letter of the pivot; column j is the distance to the word's first j letters.
        row = np.tile(place, (len(words), 1))
        for i, c in enumerate(pivot, 1):
            new = np.empty_like(row)
            new[:, 0] = i
            np.minimum(row[:, :-1] + (letters != ord(c)), row[:, 1:] + 1, out=new[:, 1:])
            # A letter left out costs one each: the least of what is before, with the way from there.
            row = np.minimum.accumulate(new - place, 1) + place
        out[:, n] = row[np.arange(len(words)), size]
    return out


def distances(words: list[str], pivot: str) -> np.ndarray:
    """Levenshtein distance of every word to one pivot."""
    return pivot_table(words, [pivot])[:, 0]


def letter_counts(words: list[str]) -> np.ndarray:
    """Letters counted in 32 classes per word, up to its COUNTED-th."""
    out = np.zeros((len(words), 32), np.int8)
    flat, size = _letters([w[:COUNTED] for w in words])
    np.add.at(out, (np.repeat(np.arange(len(words)), size), flat & 31), 1)
    return out


def cell_matches(probes: list[str], probe_d: np.ndarray, words: list[str], word_d: np.ndarray, radius: int) -> Iterator[tuple[int, int, int]]:
    """(probe, word, distance) of all pairs of one cell within the radius."""
    if not words or not probes:
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    counts = letter_counts(words)
    for k, (probe, own) in enumerate(zip(probes, letter_counts(probes), strict=True)):
        near = np.flatnonzero((np.abs(size - len(probe)) <= radius) & (np.abs(word_d - probe_d[k]) <= radius))
        if len(near):
            near = near[np.abs(counts[near].astype(np.int16) - own).sum(1) <= 2 * radius]
        for i in near.tolist():
            d = edit_distance(probe, words[i])
            if d <= radius:
                yield k, i, d


def radius_join(probes: DataFrame, words: DataFrame, radius: int, pivots: int = PIVOTS) -> DataFrame:
    """Distinct (probe, word, distance) with an edit distance of at most ``radius``.

    ``probes`` and ``words`` have one string column each; null and empty strings
    match nothing. Pivots are the words with the smallest hashes: they only shape
    the cells, the result does not depend on them. A cell's probes are dealt over
    slices and, where there are more than CELL_WORDS a cell, its words over parts,
    every probe slice meeting every part, so that no task holds a large cell whole.
    """
    spark = probes.sparkSession
    probes, words = (df.toDF(n).where(f"{n} <> ''").distinct() for df, n in ((probes, "probe"), (words, "word")))
    named = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(pivots).collect()]
    if not named:
        return spark.createDataFrame([], "probe string, word string, distance int")
    sent = spark.sparkContext.broadcast(named)

    def place(reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(0).to_pylist()
                table = pivot_table(texts, sent.value)
                if reach:
                    row, cell = np.nonzero(table <= table.min(1, keepdims=True) + reach)
                else:
                    row, cell = np.arange(len(texts)), table.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(table[row, cell].astype(np.int32))], names=["text", "cell", "d"]
                )

        return run

    placed = "text string, cell int, d int"
    parts = shuffle_width(spark)
    left = probes.mapInArrow(place(2 * radius), placed)
    right = words.mapInArrow(place(0), placed)
    slices = max(1, -(-4 * parts // pivots))
    # The largest cell decides, one figure; words that lie close together may share it.
    largest = right.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    deals = max(1, -(-largest // CELL_WORDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = left.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(slices))).withColumn("deal", every(deals))
    right = right.withColumn("slice", every(slices)).withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(deals)))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        p, w = a["text"].to_pylist(), b["text"].to_pylist()
        found = list(cell_matches(p, a["d"].to_numpy(), w, b["d"].to_numpy(), radius))
        return pa.table({"probe": pa.array([p[k] for k, _, _ in found], pa.string()), "word": pa.array([w[i] for _, i, _ in found], pa.string()), "distance": pa.array([d for _, _, d in found], pa.int32())})

    keys = ("cell", "slice", "deal")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, "probe string, word string, distance int").distinct()
