"""Abusive, hateful or sexual content: a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts letter subsequences of four to six letters that two texts
share, each occurrence weighted down by the letter it skips and by how common
the word it starts in is in the corpus, so gapped and inserted characters cost
little and everyday words tell little. A word in disguise (masked, spaced,
stretched, other script) is compared undisguised and followed by a mark, which
the kernel weighs like any letters. Landmarks taken from the labelled remarks
approximate the kernel (Nyström), a linear SVM is trained on that map, and,
because the kernel is a sum over subsequences, the trained function folds into
one weight per subsequence. A document is scored by its worst window of words;
all windows of a batch come from running sums.

Not every remark that occurs is labelled. What the trained function is sure of
is counted over the whole corpus: words that stand mostly in such remarks add
to the score of other windows. Three passes over the corpus: how common words
are, the words of sure remarks, the scores. All tables are of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.typography import plain

#: Weight of one skipped letter, and the lengths of subsequences with the letters each may skip.
DECAY, LENGTHS = 0.6, ((4, 1), (5, 1), (6, 1))
#: Size of the hashed spaces of subsequences and of words.
SPACE, WORDS = 1 << 20, 1 << 20
#: Words per window, in growing order.
WINDOWS = (3, 5, 8, 12, 16)
#: Words in at most this share of documents weigh in full; more common ones less, down to LEAST.
RARE, LEAST = 0.001, 0.02
#: Documents without a word that are thought to stand beside the corpus, so that a small one does not make every word common.
BESIDE = 1000
#: Weighted letters that a window is taken to have at least: a few everyday words are no evidence.
FLOOR = 12.0
#: At most so many labelled rows are used to fit, those with the least hashes of their ids, and so many landmarks, half of them harmful at most.
FIT_ROWS, LANDMARKS = 3000, 1200
#: Windows of the labelled harmless rows that a fit uses at most, evenly spread.
FIT_WINDOWS = 20_000
#: A window of this score is surely harmful; its words and so many beside it are counted.
SURE, AROUND = -0.15, 6
#: Documents of which a word's share in sure remarks is thought to be the usual one; the least share that counts, and its weight.
PRIOR, TELLING, WEIGHT = 5.0, 0.18, 2.0
#: Scores from here on count as found.
THRESHOLD = 0.1

# Figures and signs written for letters inside words, v for u beside them.
_WRITTEN_FOR = str.maketrans("013457@$!€|vV", "oieastasieiuu")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·]){2,}[^\W_](?![^\W_])")
_UNSEEN_BETWEEN = re.compile("(?:[^\\W\\d_][​-‍⁠﻿]+){2,}[^\\W\\d_]")
_UNSEEN = re.compile("[​-‍⁠﻿]")
_STRETCH = re.compile(r"([A-Za-z])\1{2,}")
_MASK = re.compile(r"(?<=[A-Za-z])(?:[*#@$!€|]+|__+)(?=[A-Za-z])|(?<![A-Za-z])[A-Za-z]{1,2}--+(?=[A-Za-z])|(?<=[A-Za-z])--+(?=[A-Za-z]{1,2}(?![A-Za-z]))")
_FIGURED = re.compile(r"[A-Za-z013457@$!€|]+")
_MEASURE = re.compile(r"[0-9]+[A-Za-z]{1,3}|[A-Za-z]{1,2}[0-9]+")
_CAPITALS_INSIDE = re.compile(r"[a-z][A-Z]")
_TWO_SCRIPTS = re.compile("[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")
_INSIDE = re.compile(r"(?<=[A-Za-z])[^A-Za-z~\s]+(?=[A-Za-z])")
_KEEP = re.compile(r"[^a-z#~]+")
_MARKS = re.compile(r"~[~#]*")
_MARK = "~~~~"


#: Words remembered with their compared form; emptied when full.
REMEMBERED = 200_000
_compared: dict[str, str] = {}


def _undisguised(word: str) -> str:
    """One word between spaces, its disguise undone, with ~ where there was one; # if it holds no letters."""
    w = word if word.isascii() else _UNSEEN_BETWEEN.sub(lambda m: _UNSEEN.sub("", m.group()) + "~", word)
    w = _STRETCH.sub(r"\1~", w).strip(".,;:?\"'()")
    if w.isascii() and w.isalpha() and (w.islower() or w.istitle() or w.isupper()):
        return w
    hidden = "~" in w
    core = w.rstrip("!~")
    if not core.isascii():
        hidden = hidden or _TWO_SCRIPTS.search(core) is not None
        core = plain(core) if core.islower() else "".join(c.upper() if o else c for c, o in _cased(core))
    letters_only = [c for c in core if "A" <= c <= "Z" or "a" <= c <= "z"]
    if not letters_only:
        return "#"
    if hidden and len(set(letters_only)) == 1 and len(core) < 3:  # a run of one letter is no word
        return letters_only[0]
    if not any(c in "./=:" for c in core):
        if _MASK.search(core) or _CAPITALS_INSIDE.search(core):
            hidden = True
        if _FIGURED.fullmatch(core) and not core.isalpha() and len(letters_only) > 1 and not _MEASURE.fullmatch(core):
            hidden = True
            core = core.translate(_WRITTEN_FOR)
    return _INSIDE.sub("", core.replace("~", "")) + ("~" if hidden else "")


def _word(word: str) -> str:
    """The word as compared, which may be several words or none; remembered unless it is long."""
    if len(_compared) >= REMEMBERED:
        _compared.clear()
    known = _MARKS.sub(_MARK, _KEEP.sub(" ", _undisguised(word).lower())).strip()
    if len(word) <= 40:
        _compared[word] = known
    return known


def _cased(text: str) -> Iterator[tuple[str, bool]]:
    """Plain letters of a text, each with whether it was a capital."""
    for c in text:
        for p in plain(c):
            yield p, c.isupper()


def letters(text: str) -> str:
    """The remark as compared: words of plain letters, disguises undone and marked, figures as #; '' if nothing is left."""
    t = _SPELLED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()) + "~", text)
    spoken = t.split()
    known = list(map(_compared.get, spoken))
    if None in known:
        known = [_word(w) if k is None else k for w, k in zip(spoken, known, strict=True)]
    t = " ".join(filter(None, known))
    return f" {t} " if t else ""


class Shape(NamedTuple):
    """A step from a shorter shape: the letter added, and what the shape weighs (0: only a step)."""

    base: int
    offset: int
    weight: float


def _shapes() -> list[Shape]:
    """Every subsequence's offsets from its first letter as steps from shorter ones, so that common beginnings are hashed once."""
    wanted = {(0, *rest): DECAY ** (rest[-1] - n + 1) for n, skipped in LENGTHS for rest in combinations(range(1, n + skipped), n - 1)}
    steps = sorted({o[:k] for o in wanted for k in range(1, len(o) + 1)}, key=lambda o: (len(o), o))
    at = {o: k for k, o in enumerate(steps)}
    return [Shape(at.get(o[:-1], -1), o[-1], wanted.get(o, 0.0)) for o in steps]


SHAPES = _shapes()
REACH = max(s.offset for s in SHAPES)
#: What one letter's subsequences weigh together when squared: a text's norm is the root of it times its weighted letters.
UNIT = sum(s.weight**2 for s in SHAPES)


def _hashes(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape the hashed subsequence that starts at every letter; codes are padded by REACH at the end."""
    n = len(codes) - REACH
    wide = codes.astype(np.uint32)
    made: list[np.ndarray] = []
    for base, offset, weight in SHAPES:
        h = (made[base] ^ wide[offset : offset + n] if made else wide[:n] ^ np.uint32(0x85EBCA6B)) * np.uint32(0x01000193)
        made.append(h)
        if weight:
            h = h ^ (h >> np.uint32(15))
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(12), weight


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts, each followed by a gap that no subsequence crosses; where each text starts)."""
    gap = "\x00" * REACH
    joined = gap.join(texts) + gap
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + REACH
    return np.frombuffer(joined.encode("ascii"), np.uint8), np.cumsum(sizes) - sizes


class Spread(NamedTuple):
    """The words of a batch: where each starts (at its leading space) and ends, its text's number, its bucket."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bucket: np.ndarray


def _spread(codes: np.ndarray, begins: np.ndarray) -> Spread:
    space = np.flatnonzero(codes == 32)
    if not len(space):
        none = np.zeros(0, np.int64)
        return Spread(none, none, none, none)
    opens = codes[np.minimum(space + 1, len(codes) - 1)] != 0
    start = space[opens]
    end = np.append(space, len(codes))[np.searchsorted(space, start) + 1]
    size = end - start
    power = np.cumprod(np.full(int(size.max()), 0x01000193, np.uint32), dtype=np.uint32)
    # All letters from the first word on belong to some word or to the closing space and gap after one; those weigh nothing.
    number = np.cumsum(np.bincount(start, minlength=len(codes)))[start[0] :] - 1
    place = np.arange(start[0], len(codes)) - start[number]
    inside = place < size[number]
    value = np.where(inside, codes[start[0] :] * power[np.where(inside, place, 0)], 0).astype(np.uint32)
    h = np.add.reduceat(value, start - start[0], dtype=np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return Spread(start, end, np.searchsorted(begins, start, side="right") - 1, (h >> np.uint32(12)).astype(np.int64) & (WORDS - 1))


def _per_letter(values: np.ndarray, words: Spread, size: int) -> np.ndarray:
    """Each word's value at all its letters, 0 elsewhere."""
    out = np.zeros(size)
    length = words.end - words.start
    first = np.cumsum(length) - length
    out[np.repeat(words.start - first, length) + np.arange(int(length.sum()))] = np.repeat(values, length)
    return out


def _windows(words: Spread) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word) of all windows; one never crosses into another text; a short text is a window of its own."""
    n = len(words.start)
    first, last = [], []
    for size in WINDOWS:
        k = np.arange(max(0, n - size + 1))
        k = k[words.text[k] == words.text[k + size - 1]]
        first.append(k)
        last.append(k + size - 1)
    begin = np.flatnonzero(np.diff(words.text, prepend=-1))
    close = np.append(begin[1:], n) - 1
    short = close - begin < WINDOWS[-1]
    return np.concatenate([*first, begin[short]]), np.concatenate([*last, close[short]])


class Rarity:
    """How much words tell: 1 for rare ones, less for common ones; ``counts`` of documents per bucket, of ``documents``."""

    def __init__(self, counts: np.ndarray | None = None, documents: int = 0) -> None:
        share = ((0 if counts is None else counts) + np.full(WORDS, 0.5)) / (documents + BESIDE)
        self.weight = np.clip(np.log(share) / np.log(RARE), LEAST, 1.0).astype(np.float32)


class Piece(NamedTuple):
    """A window of a labelled remark: its letters and what each weighs."""

    text: str
    weight: np.ndarray


def _pieces(text: str, rarity: Rarity) -> list[Piece]:
    """All windows of a compared text, the whole text last."""
    codes, begins = _codes([text])
    words = _spread(codes, begins)
    weight = _per_letter(rarity.weight[words.bucket], words, len(codes))
    first, last = _windows(words)
    cut = lambda s, e: Piece(text[s : e + 1], np.append(weight[s:e], 0.0))
    return [cut(s, e) for s, e in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)] + [cut(0, len(text) - 1)]


def spectrum(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Sparse normalised features (places, values) of one window."""
    codes, _ = _codes([piece.text])
    places, values = [], []
    for h, weight in _hashes(codes):
        places.append(h)
        values.append(weight * piece.weight)
    places, inverse = np.unique(np.concatenate(places), return_inverse=True)
    return places, np.bincount(inverse, np.concatenate(values)) / np.sqrt(UNIT * max(FLOOR, float((piece.weight**2).sum())))


def _gram(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    places, values = (np.concatenate([x[k] for x in a]) for k in (0, 1))
    sizes = np.array([len(x[0]) for x in a])
    # Places that no landmark has add nothing to any product.
    known = np.zeros(SPACE, bool)
    known[np.concatenate([p for p, _ in b])] = True
    kept = known[places]
    starts = np.concatenate([[0], np.cumsum(np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64))[:-1]])
    places, values = np.append(places[kept], 0), np.append(values[kept], 0.0).astype(np.float32)
    empty = np.diff(np.append(starts, len(places) - 1)) == 0
    out = np.empty((len(a), len(b)), np.float32)
    dense = np.zeros(SPACE, np.float32)
    for j, (p, v) in enumerate(b):
        dense[p] = v
        out[:, j] = np.add.reduceat(dense[places] * values, starts)
        dense[p] = 0
    out[empty] = 0
    return out


def _projected(texts: list[str], rarity: Rarity, marks: list[tuple[np.ndarray, np.ndarray]], pick: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text of each picked window, its kernel with every landmark), as scores sum windows up: one running sum per landmark.

    ``pick`` chooses windows by (their letters, their texts, their sizes in words).
    """
    codes, begins = _codes(texts)
    words = _spread(codes, begins)
    first, last = _windows(words)
    joined = codes.tobytes().decode("ascii")
    cut = [joined[s : e + 1] for s, e in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)]
    chosen = pick(cut, words.text[first], last - first + 1)
    first, last = first[chosen], last[chosen]
    rare = rarity.weight[words.bucket].astype(np.float64)
    by_letter, length = _per_letter(rare, words, len(codes)), words.end - words.start
    mass = np.concatenate([[0.0], np.cumsum(rare * rare * length)])
    norm = np.sqrt(UNIT * np.maximum(FLOOR, mass[last + 1] - mass[first]))
    hashed, start, end = list(_hashes(codes)), words.start[first], words.end[last]
    out, dense = np.empty((len(first), len(marks)), np.float32), np.zeros(SPACE, np.float32)
    for j, (places, values) in enumerate(marks):
        dense[places] = values
        each = np.zeros(len(codes) - REACH, np.float32)
        for h, weight in hashed:
            each += np.float32(weight) * dense[h]
        dense[places] = 0
        running = np.concatenate([[0.0], np.cumsum(each * by_letter[: len(each)])])
        out[:, j] = (running[end] - running[start]) / norm
    return words.text[first], out


def _distinct_windows(cut: list[str], text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One window of equal ones, evenly spread over their letters where there are too many."""
    del text, size
    at: dict[str, int] = {}
    for k, c in enumerate(cut):
        at.setdefault(c, k)
    return np.array(_spaced([at[c] for c in sorted(at)], FIT_WINDOWS), np.int64)


def _telling_windows(cut: list[str], text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Windows by text, the longest last: the shortest are too little to tell what in a harmful remark is harmful, but for remarks as short."""
    del cut
    longest = np.zeros(int(text.max()) + 1, np.int64)
    np.maximum.at(longest, text, size)
    kept = np.flatnonzero(size > np.minimum(WINDOWS[0], longest[text] - 1))
    return kept[np.lexsort((size[kept], text[kept]))]


def hinge_weights(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM by dual coordinate descent, rows at their bound put aside after a round; the last column of z is the constant."""
    alpha, w = np.zeros(len(y)), np.zeros(z.shape[1])
    square = np.maximum((z * z).sum(1), 1e-12)
    dice = np.random.default_rng(7)
    for k in range(rounds):
        # Rows far on their right side stay at 0; all rows are looked at again every fifth round.
        order = np.arange(len(y)) if k % 5 == 0 else np.flatnonzero((alpha > 0) | (y * (z @ w) < 1.1))
        dice.shuffle(order)
        for i in order:
            new = min(max(alpha[i] - (y[i] * (z[i] @ w) - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
    return w


def _spaced(rows: list, most: int) -> list:
    return rows[:: max(1, -(-len(rows) // max(1, most)))]


class RemarkModel:
    """The trained function: one weight per hashed subsequence, a constant, how much words tell, and the telling words."""

    def __init__(self, weights: np.ndarray, constant: float, rarity: np.ndarray | None = None, telling: np.ndarray | None = None) -> None:
        self.weights, self.constant = weights.astype(np.float32), float(constant)
        self.rarity = Rarity().weight if rarity is None else rarity
        self.telling = telling

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], rarity: Rarity | None = None, cost: float = 20.0) -> RemarkModel:
        """Train on (text, label); every window of a harmless remark is harmless, of the others the worst one counts."""
        rarity = rarity or Rarity()
        remarks = sorted({(letters(t), label != "none") for t, label in rows if t and label})
        remarks = [r for r in remarks if r[0]]
        if len({b for _, b in remarks}) < 2:
            return cls(np.zeros(SPACE), 0.0, rarity.weight)
        good_texts, bad_texts = ([t for t, b in remarks if b == bad] for bad in (False, True))
        harmless = {p.text: p for t in good_texts for p in _pieces(t, rarity)}
        bad_marks = [_pieces(t, rarity)[-1] for t in _spaced(bad_texts, LANDMARKS // 2)]
        marks = [spectrum(p) for p in [*bad_marks, *_spaced([harmless[t] for t in sorted(harmless)], LANDMARKS - len(bad_marks))]]
        values, vectors = np.linalg.eigh(_gram(marks, marks).astype(np.float64))
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        one = lambda z: np.hstack([z, np.ones((len(z), 1))])
        good_z = one(_projected(good_texts, rarity, marks, _distinct_windows)[1] @ root)
        owner, flat = _projected(bad_texts, rarity, marks, _telling_windows)
        flat_z = one(flat @ root)
        ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
        chosen, w = ends - 1, np.zeros(root.shape[1] + 1)
        for _ in range(3):
            z = np.vstack([flat_z[chosen], good_z])
            y = np.concatenate([np.ones(len(chosen)), -np.ones(len(good_z))])
            share = np.where(y > 0, cost, cost * len(chosen) / max(1, len(good_z)) * 4)
            w = hinge_weights(z, y, share)
            # The worst window of each remark, the last one of equals.
            chosen = np.lexsort((flat_z @ w, owner))[ends - 1]
        beta = root @ w[:-1]
        weights = np.zeros(SPACE)
        for b, (places, value) in zip(beta, marks, strict=True):
            weights[places] += b * value
        return cls(weights, w[-1], rarity.weight)

    def _values(self, compared: list[str]) -> tuple[Spread, np.ndarray, np.ndarray, np.ndarray]:
        """(words, first words, last words, scores) of all windows of a batch."""
        codes, begins = _codes(compared)
        words = _spread(codes, begins)
        first, last = _windows(words)
        if not len(first):
            return words, first, last, np.zeros(0)
        each = np.zeros(len(codes), np.float32)
        for h, weight in _hashes(codes):
            each[: len(h)] += np.float32(weight) * self.weights[h]
        rare = self.rarity[words.bucket].astype(np.float64)
        by_letter = _per_letter(rare, words, len(codes))
        running = np.concatenate([[0.0], np.cumsum(each * by_letter)])
        length = words.end - words.start
        word_sum = running[words.end] - running[words.start]
        if self.telling is not None:
            word_sum = word_sum + WEIGHT * self.telling[words.bucket] * rare * length
        total, mass = (np.concatenate([[0.0], np.cumsum(x)]) for x in (word_sum, rare * rare * length))
        value = (total[last + 1] - total[first]) / np.sqrt(UNIT * np.maximum(FLOOR, mass[last + 1] - mass[first])) + self.constant
        return words, first, last, value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text's worst window; empty, blank and null texts get the constant."""
        words, first, _, value = self._values([letters(t) if t else "" for t in texts])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, words.text[first], value)
        return np.where(np.isfinite(best), best, self.constant)

    def sure_words(self, texts: list[str | None]) -> tuple[np.ndarray, int]:
        """(buckets of the words in and around sure windows, each once per text; texts with such a window)."""
        words, first, last, value = self._values([letters(t) if t else "" for t in texts])
        sure = value >= SURE
        n = len(words.start)
        edge = np.zeros(n + 1, np.int64)
        begin = np.searchsorted(words.text, words.text[first[sure]])
        close = np.searchsorted(words.text, words.text[first[sure]], side="right")
        np.add.at(edge, np.maximum(begin, first[sure] - AROUND), 1)
        np.add.at(edge, np.minimum(close, last[sure] + 1 + AROUND), -1)
        marked = np.cumsum(edge)[:n] > 0
        return _distinct_buckets(words.text[marked], words.bucket[marked]), len(np.unique(words.text[first[sure]]))


def _distinct_buckets(text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Buckets, each once per text."""
    return np.unique(text * WORDS + bucket) % WORDS


#: Texts that are compared at once, and the letters after which fewer are.
TEXTS, LETTERS = 400, 400_000


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts.to_pylist():
        group.append(t)
        size += len(t) if t else 0
        if len(group) == TEXTS or size >= LETTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _counted(documents: DataFrame, words_of: Callable[[], Callable[[list[str | None]], tuple[np.ndarray, int]]]) -> tuple[np.ndarray, int]:
    """Documents per bucket of words, and documents that count at all: summed per task, then over tasks; WORDS figures reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts, total = words_of(), np.zeros(WORDS, np.int64), 0
        for batch in batches:
            for group in _groups(batch.column(0)):
                buckets, counted = find(group)
                np.add.at(counts, buckets, 1)
                total += counted
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], total))], names=["bucket", "n"])

    summed = documents.select("text").where("text is not null").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (summed.column(c).to_numpy() for c in ("bucket", "n"))
    counts = np.zeros(WORDS, np.int64)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, int(n[bucket < 0].sum())


def _words_of(group: list[str | None]) -> tuple[np.ndarray, int]:
    codes, begins = _codes([letters(t) if t else "" for t in group])
    words = _spread(codes, begins)
    return _distinct_buckets(words.text, words.bucket), len(group)


def fit_remarks(examples: DataFrame, documents: DataFrame) -> RemarkModel:
    """The model of the labelled table, trained on the driver on at most FIT_ROWS rows; word counts are over all documents."""
    labelled = examples.where("text is not null and label is not null").orderBy(F.xxhash64("example_id"), "example_id", "text").limit(FIT_ROWS).select("text", "label")
    counts, total = _counted(documents, lambda: _words_of)
    model = RemarkModel.fit([(r.text, r.label) for r in labelled.collect()], Rarity(counts, total))
    if not model.weights.any():
        return model
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.constant, model.rarity))
    sure, remarks = _counted(documents, lambda: RemarkModel(*sent.value).sure_words)
    share = (sure + PRIOR * remarks / max(1, total)) / (counts + PRIOR)
    model.telling = np.where((sure > 0) & (share > TELLING), share, 0.0).astype(np.float32)
    return model


def score_documents(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every row; higher is worse, null and empty texts get the model's constant.

    Whole texts are read; repeated rows stay; further columns are not read; an
    empty table gives no rows, and without labelled rows every score is 0.
    """
    spark = documents.sparkSession
    model = fit_remarks(examples, documents)
    sent = spark.sparkContext.broadcast((model.weights, model.constant, model.rarity, model.telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = RemarkModel(*sent.value)
        for batch in batches:
            parts = [own.scores(group) for group in _groups(batch.column(2))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "source", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, score double")


def find_harmful(documents: DataFrame, examples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct doc_id of the documents whose score is above the threshold."""
    return score_documents(documents, examples).where(F.col("score") > threshold).select("doc_id").distinct()


def harmful_rates(documents: DataFrame, examples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, found, rate) over all documents; a null source is a source of its own."""
    scored = score_documents(documents, examples)
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum((F.col("score") > threshold).cast("long")).alias("found"), F.avg((F.col("score") > threshold).cast("double")).alias("rate")
    )
