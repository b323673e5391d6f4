"""Byte-level BPE over whole partitions by a pair occurrence index.

The distinct pieces of a batch stand in one array of symbols. An index maps
every adjacent pair that has a merge rank to all its positions; ranks are
applied in ascending order, each to all its positions at once, and only the
lists of the neighbouring pairs are updated. Pieces seen before in the same
Python worker are looked up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how the vocabulary's texts are cut into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces remembered per worker; beyond it the memory is emptied, which costs time only.
REMEMBERED = 1_000_000


def default_vocabulary() -> str:
    """Place of the public vocabulary byte_bpe_50k on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter by which a vocabulary file writes each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


class PairIndexEncoder:
    """Encoder of texts by one vocabulary (the content of a tokenizers JSON file)."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        ids = model["vocab"]
        self.of_byte = np.array([ids[c] for c in byte_letters()], np.int32)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece)."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        symbol = self.of_byte[raw].tolist()
        n = len(symbol)
        last = np.ones(n, bool)
        last[:-1] = owner[1:] != owner[:-1]
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(np.concatenate([[True], last[:-1]]) if n else last, -1, np.arange(-1, n - 1)).tolist()
        merges = self.merges
        places: dict[tuple[int, int], list[int]] = {}
        for at, nxt in enumerate(after):
            if nxt >= 0:
                pair = (symbol[at], symbol[nxt])
                if pair in merges:
                    places.setdefault(pair, []).append(at)
        active = [(merges[p][0], p) for p in places]
        heapify(active)
        while active:
            _, pair = heappop(active)
            at_list = places.pop(pair, None)
            if at_list is None:
                continue
            at_list.sort()
            a, b = pair
            merged = merges[pair][1]
            for at in at_list:
                nxt = after[at]
                # A place is stale once either symbol has gone into another merge.
                if symbol[at] != a or nxt < 0 or symbol[nxt] != b:
                    continue
                symbol[at], symbol[nxt] = merged, -1
                far = after[nxt]
                after[at] = far
                after[nxt] = -1
                if far >= 0:
                    before[far] = at
                    new = (merged, symbol[far])
                    if new in merges:
                        if new not in places:
                            places[new] = []
                            heappush(active, (merges[new][0], new))
                        places[new].append(at)
                near = before[at]
                if near >= 0:
                    new = (symbol[near], merged)
                    if new in merges:
                        if new not in places:
                            places[new] = []
                            heappush(active, (merges[new][0], new))
                        places[new].append(near)
        ids = np.array(symbol, np.int32)
        kept = ids >= 0
        return ids[kept], np.bincount(owner[kept], minlength=len(pieces))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); none for an empty or null text."""
        if len(self.known) > REMEMBERED:
            self._clear()
        known, fresh = self.known, []
        found: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            pieces = self.pieces.findall(text)
            counts[k] = len(pieces)
            for piece in pieces:
                at = known.get(piece)
                if at is None:
                    at = known[piece] = len(known)
                    fresh.append(piece.encode("utf-8", "replace"))
                found.append(at)
        if fresh:
            flat, lengths = self.merge_all(fresh)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, flat])
            self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        piece = np.array(found, np.int64)
        sizes = self.lengths[piece]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - sizes, sizes)
        ids = self.flat[np.repeat(self.starts[piece], sizes) + within]
        text_of = np.repeat(np.arange(len(texts)), counts)
        return ids, np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)


_ENCODERS: dict[int, PairIndexEncoder] = {}


def encode_texts(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: whole texts, no special tokens.

    Empty and null texts give the empty list; repeated rows stay repeated; an
    empty table gives no rows; further columns are not read. ``vocabulary`` is
    the path of a tokenizers JSON file, read once by the driver; its content
    (1.6 MB, fixed) is what the tasks get.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        content = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(content.value)
        if mark not in _ENCODERS:
            _ENCODERS[mark] = PairIndexEncoder(content.value)
        encoder = _ENCODERS[mark]
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, documents[text].cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
