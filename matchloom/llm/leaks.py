"""Evaluation texts leaking into training text: BM25 with block maxima, then verification.

The sentences of the items' passages are the indexed units. Stretches of every
document query the index with their words; a unit comes back if its BM25 score
reaches a set part of the score it has with itself. What comes back is verified
by an in-order word alignment that forgives a changed, missing or misspelled
word, and the verified sentences are added up per item. How much of the item's
question and answer the document holds is reported beside it.

Word statistics are over all items, and a unit's score depends on nothing else,
so that it does not matter which items share an index.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain
from math import log1p
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.metric import shortened
from matchloom.llm.typography import whole_words, words

#: BM25's parameters.
K1, B = 1.2, 0.5
#: Part of a sentence's own score that makes it a candidate.
CANDIDATE = 0.62
#: Part of a sentence's weight that must be aligned for the sentence to be held.
HELD = 0.74
#: Part of the passage's words that the held sentences must make up ("at least about a third").
COVERED = 0.27
#: Units per block of the index.
BLOCK = 8
#: Letters of passages that are indexed at once: what is sent to the tasks is bounded by this, further items take further passes.
PASS_LETTERS = 4_000_000
#: Bounds of windows and blocks that are looked at in one step, and the words read before that.
STEP, STEP_WORDS = 4_000_000, 50_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Item(NamedTuple):
    """An evaluation item; texts that are null or empty hold nothing."""

    item_id: int
    passage: str | None
    question: str | None = None
    answer: str | None = None


def sentences(passage: str | None) -> list[list[str]]:
    """The words of each sentence that has any."""
    return [w for s in _SENTENCE.split(passage or "") if (w := words(s))]


class WordStatistics:
    """What words weigh, over the sentences of all items, and which word a misspelled one stands for."""

    def __init__(self, passages: Iterable[str | None]) -> None:
        seen: dict[str, int] = {}
        self.units, total, self.longest = 0, 0, 0
        for passage in passages:
            for unit in sentences(passage):
                self.units += 1
                total += len(unit)
                self.longest = max(self.longest, len(unit))
                for w in set(unit):
                    seen[w] = seen.get(w, 0) + 1
        self.mean = total / self.units if self.units else 1.0
        self.idf = {w: log1p((self.units - f + 0.5) / (f + 0.5)) for w, f in sorted(seen.items())}
        self.term = {w: k for k, w in enumerate(self.idf)}

    def read(self) -> WordReader:
        return WordReader(self)


class WordReader:
    """Reads words as indexed terms: itself, or one that is a slip of a key away."""

    def __init__(self, statistics: WordStatistics) -> None:
        self.near: dict[str, int] = {}
        for w in sorted(statistics.term, key=lambda w: (-statistics.idf[w], w)):
            if len(w) >= 4 and not w.isdigit():
                for s in shortened(w):
                    self.near.setdefault(s, statistics.term[w])
        self.exact = statistics.term
        self.remembered: dict[str, tuple[int, ...]] = {}

    def term(self, word: str) -> int:
        """The word's term, -1 if it stands for none."""
        known = self.exact.get(word, -1)
        if known < 0 and 4 <= len(word) <= 60 and not word.isdigit():
            known = next((self.near[s] for s in shortened(word) if s in self.near), -1)
        return known

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The terms of what stands between two spaces; remembered unless it is long."""
        if len(self.remembered) > 500_000:
            self.remembered.clear()
        known = tuple(map(self.term, words(piece)))
        if len(piece) <= 60:
            self.remembered[piece] = known
        return known

    def terms(self, text: str | None) -> np.ndarray:
        pieces = whole_words(text or "").split()
        known = list(map(self.remembered.get, pieces))
        if None in known:
            known = [self._piece(p) if k is None else k for p, k in zip(pieces, known, strict=True)]
        return np.array(list(chain.from_iterable(known)), np.int64)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its range, position) of everything in the ranges."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


class SentenceIndex:
    """Posting lists of terms over sentences, in blocks with their maxima; what a sentence gets is a part of its own score."""

    def __init__(self, items: Iterable[Item], statistics: WordStatistics) -> None:
        self.statistics = statistics
        self.reader = statistics.read()
        self.idf = np.array(list(statistics.idf.values()))
        self.item: list[Item] = []
        self.units: list[np.ndarray] = []
        self.total: dict[int, int] = {}
        for item in items:
            for unit in sentences(item.passage):
                self.item.append(item)
                self.units.append(np.array([statistics.term[w] for w in unit]))
                self.total[item.item_id] = self.total.get(item.item_id, 0) + len(unit)
        term, owner, part = [], [], []
        for k, unit in enumerate(self.units):
            found, times = np.unique(unit, return_counts=True)
            own = self.idf[found] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(unit) / statistics.mean))
            term.append(found)
            owner.append(np.full(len(found), k))
            part.append(own / own.sum())
        none = np.zeros(0, np.int64)
        term, owner, part = (np.concatenate(x) if x else none for x in (term, owner, part))
        order = np.lexsort((owner, term))
        term, self.owner, self.part = term[order], owner[order], part[order]
        # Each term's postings lie block by block; a cell is one term's part of one block.
        self.blocks = -(-len(self.units) // BLOCK)
        cell = term * max(1, self.blocks) + self.owner // BLOCK
        cells, self.cell_start, self.cell_count = np.unique(cell, return_index=True, return_counts=True)
        self.cell_block = cells % max(1, self.blocks)
        self.cell_most = np.maximum.reduceat(self.part, self.cell_start) if len(cells) else np.zeros(0)
        self.term_start = np.searchsorted(cells // max(1, self.blocks), np.arange(len(self.idf) + 1))
        #: Words that a sentence's alignment may lie in, and so the words by which windows must overlap.
        self.reach = 2 * self.span(statistics.longest)

    @staticmethod
    def span(size: int) -> int:
        return int(size * 1.5) + 6

    def candidates(self, window: np.ndarray, term: np.ndarray, windows: int, least: float = CANDIDATE) -> tuple[np.ndarray, np.ndarray]:
        """(window, unit) of all units whose score with a window's terms reaches ``least``; pairs of window and term are distinct.

        Block-max pruning with the pivots of all blocks found at once: the sums of
        block maxima say which blocks of a window can hold such a unit, and only
        their postings are read. Nothing is cut off.
        """
        if not self.blocks or not len(term):
            none = np.zeros(0, np.int64)
            return none, none
        owner, cell = _ranges(self.term_start[term], self.term_start[term + 1] - self.term_start[term])
        place = window[owner] * self.blocks + self.cell_block[cell]
        bound = np.bincount(place, self.cell_most[cell], windows * self.blocks)
        open_ = bound[place] >= least - 1e-9
        owner, cell = owner[open_], cell[open_]
        at, posting = _ranges(self.cell_start[cell], self.cell_count[cell])
        key = window[owner[at]] * len(self.units) + self.owner[posting]
        keys, inverse = np.unique(key, return_inverse=True)
        keys = keys[np.bincount(inverse, self.part[posting], len(keys)) >= least - 1e-9]
        return keys // len(self.units), keys % len(self.units)

    def aligned(self, unit: np.ndarray, text: np.ndarray, least: float = 0.0) -> float:
        """Part of the unit's weight that stands in the text in order and close together; 0 where it can't reach ``least``."""
        weight = self.idf[unit] + 0.3
        held = np.isin(unit, text)
        # What stands there at all bounds what stands there in order.
        if not held.any() or weight[held].sum() < least * weight.sum():
            return 0.0
        hits = np.flatnonzero(np.isin(text, unit))
        # The span of words that holds most of the unit's weight, by the hit that ends it.
        span = self.span(len(unit))
        running = np.cumsum(self.idf[text[hits]])
        low = np.searchsorted(hits, hits - span, side="right")
        at = int(hits[np.argmax(running - np.where(low > 0, running[np.maximum(low, 1) - 1], 0.0))])
        part = text[max(0, at - span + 1 - len(unit) // 3) : at + 1 + len(unit) // 3]
        row = np.zeros(len(part) + 1)
        for w, x in zip(unit.tolist(), weight.tolist(), strict=True):
            # Either the word is left out, or it stands at one of its places after what came before.
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(part == w, row[:-1] + x, 0.0)))
        return float(row[-1] / weight.sum())

    def _step(self, texts: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, Item, float]]:
        windows = [(n, found[k : k + 2 * self.reach]) for n, found in texts for k in range(0, max(1, len(found) - self.reach), self.reach)]
        for low in range(0, len(windows), size := max(1, STEP // max(1, self.blocks))):
            part = windows[low : low + size]
            number = np.repeat(np.arange(len(part)), [len(w) for _, w in part])
            term = np.concatenate([w for _, w in part])
            pair = np.unique((number * len(self.idf) + term)[term >= 0])
            if len(pair):
                for w, u in zip(*self.candidates(pair // len(self.idf), pair % len(self.idf), len(part)), strict=True):
                    if self.aligned(self.units[u], part[w][1], HELD) >= HELD:
                        yield part[w][0], int(u)

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, Item, float]]:
        """(number of the text, item, part of its passage) of all items that a text holds enough of."""
        step, size = [], 0
        held: set[tuple[int, int]] = set()
        for n, text in enumerate(texts):
            found = self.reader.terms(text)
            if len(found):
                step.append((n, found))
                size += len(found)
            if size >= STEP_WORDS:
                held.update(self._step(step))
                step, size = [], 0
        held.update(self._step(step))
        parts: dict[tuple[int, int], int] = {}
        items: dict[int, Item] = {}
        for n, u in held:
            item = self.item[u]
            items[item.item_id] = item
            parts[n, item.item_id] = parts.get((n, item.item_id), 0) + len(self.units[u])
        for (n, i), size in sorted(parts.items()):
            if size / self.total[i] >= COVERED:
                yield n, items[i], size / self.total[i]


def overlap(text: str, other: str | None) -> float:
    """Part of the distinct words of ``other`` that the text holds; 0 where there are none."""
    wanted = set(words(other or ""))
    return len(wanted & set(words(text))) / len(wanted) if wanted else 0.0


def holds(text: str, other: str | None) -> bool:
    """Whether the text holds all words of ``other`` in a row."""
    return bool(wanted := words(other or "")) and f" {' '.join(wanted)} " in f" {' '.join(words(text))} "


#: The index a worker last built, by the broadcast it came from.
_built: dict[str, SentenceIndex] = {}


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, passage_part, question_part, answer_held): the document holds enough of the item's passage.

    ``passage_part`` is the part of the passage's words in held sentences,
    ``question_part`` that of the question's distinct words, ``answer_held`` whether
    the answer stands in the document; neither of the two makes a case. Null and
    empty texts or passages hold nothing; repeated rows count once; of equal
    passages every item is reported; empty tables give no rows. Whole texts are
    read, of any length. Further columns are not read.
    """
    spark = documents.sparkSession
    total = items.where("passage is not null").select("item_id", "passage", "question", "answer").distinct().orderBy("item_id", "passage", "question", "answer")
    statistics = WordStatistics(r.passage for r in total.select("passage").toLocalIterator())
    known = spark.sparkContext.broadcast(statistics)
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, passage_part double, question_part double, answer_held boolean"
    texts = documents.where("text is not null").select("doc_id", "text")

    def over(part: list[Item]) -> DataFrame:
        sent, mark = spark.sparkContext.broadcast(part), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if mark not in _built:
                _built.clear()
                _built[mark] = SentenceIndex(sent.value, known.value)
            index = _built[mark]
            for batch in batches:
                listed = batch.column(1).to_pylist()
                found = [(n, item.item_id, part, overlap(listed[n], item.question), holds(listed[n], item.answer)) for n, item, part in index.leaks(listed)]
                if found:
                    at, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], names=["doc_id", "item_id", "passage_part", "question_part", "answer_held"])

        return texts.mapInArrow(run, kind)

    part, size, passes = [], 0, []
    for row in total.toLocalIterator():
        part.append(Item(*row))
        size += len(row.passage)
        if size >= PASS_LETTERS:
            passes.append(over(part))
            part, size = [], 0
    if part or not passes:
        passes.append(over(part))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found.distinct()


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of leak_report."""
    return leak_report(documents, items).select("doc_id", "item_id").distinct()
