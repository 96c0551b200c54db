"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are folded to their lower-case letters and digits. An item of n
q-grams that occurs in a text with at most k edits shares at least n - q*k of them with it,
on diagonals (place in the text minus place in the item) that lie within k of each other.
So shared q-grams are counted in overlapping bands of diagonals, a band that reaches the
bound is a candidate, and banded alignment settles whether the item occurs there within its
budget of edits. k is `RATE` of n.

An item longer than `PIECE` characters is sought in overlapping pieces. Every item longer than
`PART` is also sought in overlapping parts of that length: whatever its length, a passage of
one and a half parts holds a part whole and is found. A part is reported where no piece of its
item is. An item with fewer than `LEAST` folded characters has a budget of no edits and few
q-grams or none; it is found, by an automaton over all such items, wherever it stands exactly
between the ends of words.

Distinct texts of items travel to the documents in blocks of a bounded size, one pass over the
documents per block, so a large benchmark costs passes and not memory. A text is sought once,
however many items have it; their item_ids join its matches in Spark.

Defined results: a null or blank text has no matches; items that are null or fold to nothing
are not sought; equal items are each reported. A null doc_id and repeated rows give their
matches like any other row. Texts are read whole, in stretches that overlap by more than a
match can span. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import narrow, small, table, texts_of

Q = 10
RATE = 0.06
PIECE = 400
PART = 100
LEAST = 50
WINDOW = 32  # q-grams in which a text must show enough hits to be looked at
STRETCH = 1 << 20  # folded characters that are searched at once
BLOCK_CHARACTERS = 4 << 20  # of items that are sent to the documents at once
_SLOTS = 20  # bits of the table that tells whether a q-gram can occur in an item
_FACTOR = 0x01000193  # odd multiplier of the rolling hash, any would do

Match = tuple[int, int, int, int]  # item_id, start, end, edits


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to its lower-case form for letters and digits, to 0 for the rest."""
    lower = (chr(c).lower() if chr(c).isalnum() else "\0" for c in range(0x110000))
    return np.array([ord(x) if len(x) == 1 else ord(x[0]) for x in lower], np.uint32)


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters and where in the text each one stands."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    places = np.flatnonzero(codes)
    return codes[places], places


def _characters(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """The polynomial hash of every q-gram, put together from hashes of powers of two."""
    out, have, power, length = None, 0, codes.astype(np.uint32), 1
    factor = np.uint32(_FACTOR)
    while True:
        if q & length:
            if out is None:
                out, have = power, length
            else:
                # The shorter part goes behind, so it is moved by its own length.
                size = len(power) - have
                out = power[:size] * _raised(have) + out[length : length + size] if size > 0 else out[:0]
                have += length
        length *= 2
        if length > q:
            return out[: max(0, len(codes) - q + 1)]
        half = length // 2
        power = power[:-half] * _raised(half) + power[half:] if len(power) > half else power[:0]


def _raised(n: int) -> np.uint32:
    return np.uint32(pow(_FACTOR, n, 1 << 32))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - _SLOTS)


def _piece(item_id: int, codes: np.ndarray) -> tuple[int, np.ndarray, int, int]:
    count = len(codes) - Q + 1
    edits = int(RATE * count)
    return item_id, codes, edits, count - Q * edits


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.pieces: list[tuple[int, np.ndarray, int, int]] = []  # item_id, characters, edits, shared q-grams at least
        self.short = ahocorasick.Automaton()
        short: dict[str, list[tuple[int, int]]] = {}  # folded characters to items, each with a number below 0
        parts: list[tuple[int, np.ndarray, int, int]] = []
        for numbered, (item_id, text) in enumerate(items):
            codes, _ = fold(text or "")
            if 0 < len(codes) < LEAST:
                short.setdefault(_characters(codes), []).append((-1 - numbered, item_id))
            for start in range(0, max(1, len(codes) - PIECE // 2), PIECE // 2) if len(codes) >= LEAST else ():
                self.pieces.append(_piece(item_id, codes[start : start + PIECE]))
            if len(codes) > PART:
                last = len(codes) - PART
                parts += [_piece(item_id, codes[start : start + PART]) for start in [*range(0, last, PART // 2), last]]
        for letters, ids in short.items():
            self.short.add_word(letters, (len(letters), ids))
        self.short.make_automaton()
        self.parts_from = len(self.pieces)
        self.pieces += parts
        hashed = [grams(p[1]) for p in self.pieces]
        flat = np.concatenate([np.empty(0, np.uint32), *hashed])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.piece = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(h)) for h in hashed)])[order].astype(np.int64)
        self.known = np.zeros(1 << _SLOTS, bool)
        self.known[_slot(self.hashes)] = True
        self.reach = max((len(p[1]) + 2 * p[2] + Q for p in self.pieces), default=0)
        # Of the windows that a match spans, one holds at least this many hits.
        self.dense = min((-(-p[3] // -(-(len(p[1]) + p[2]) // WINDOW)) for p in self.pieces), default=1)

    def _candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(piece, first and last diagonal) of every band with enough shared q-grams."""
        hit = self.known[_slot(hashes)]
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        starts = np.arange(0, len(hit), WINDOW // 2)
        full = sums[np.minimum(starts + 2 * WINDOW, len(hit))] - sums[starts] >= self.dense
        if not full.any():
            return
        # Around each dense window, whatever a match that covers it can span.
        change = np.zeros(len(hit) + 1, np.int32)
        np.add.at(change, np.maximum(starts[full] - self.reach, 0), 1)
        np.add.at(change, np.minimum(starts[full] + 2 * WINDOW + self.reach, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(change[:-1]) > 0))
        low = np.searchsorted(self.hashes, hashes[at], side="left")
        many = np.searchsorted(self.hashes, hashes[at], side="right") - low
        where = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        piece, diagonal = self.piece[where], np.repeat(at, many) - self.place[where]
        if not len(piece):
            return
        wide = np.array([p[2] + 1 for p in self.pieces])[piece]
        need = np.array([p[3] for p in self.pieces])
        band = diagonal // wide
        # Every diagonal counts for two bands, so any k + 1 neighbours lie together in one.
        keys = np.stack([np.concatenate([piece, piece]), np.concatenate([band, band - 1])])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        counts = np.diff(np.append(first, keys.shape[1]))
        for number, own, count in zip(keys[0, first].tolist(), keys[1, first].tolist(), counts.tolist()):
            if count >= need[number]:
                width = self.pieces[number][2] + 1
                yield number, own * width, (own + 2) * width - 1

    def search(self, text: str) -> list[Match]:
        """The items that occur in a text, with the stretch of the text that holds them."""
        codes, places = fold(text)
        found: list[tuple[int, Match]] = []
        if len(self.short):
            # Between neighbours that do not touch in the text a word ends.
            ends = np.concatenate([[True], np.diff(places) > 1, [True]])
            for last, (size, ids) in self.short.iter(_characters(codes)):
                start = last + 1 - size
                if ends[start] and ends[last + 1]:
                    found += [(number, (k, int(places[start]), int(places[last]) + 1, 0)) for number, k in ids]
        for start in range(0, len(codes) if self.pieces else 0, STRETCH):
            part = codes[start : start + STRETCH + 2 * self.reach]
            for number, low, high in self._candidates(grams(part)):
                item, piece, budget, _ = self.pieces[number]
                if hit := align(piece, part, low, high, budget):
                    a, b, edits = hit
                    found.append((number, (item, int(places[start + a]), int(places[start + b - 1]) + 1, edits)))
        wide = _best([f for f in found if f[0] < self.parts_from])
        parts = _best([f for f in found if f[0] >= self.parts_from])
        lone = [m for m in parts if not any(w[0] == m[0] and w[1] < m[2] and m[1] < w[2] for w in wide)]
        return _sorted(wide + lone)


def _sorted(matches: list[Match]) -> list[Match]:
    return sorted(matches, key=lambda m: (m[1:], str(m[0])))


def _best(found: list[tuple[int, Match]]) -> list[Match]:
    """Of matches of one piece that overlap, as bands and stretches do, the one with the fewest edits."""
    kept: dict[int, list[Match]] = {}
    for number, match in sorted(found, key=lambda f: (f[1][3], f[1][1], f[1][2])):
        own = kept.setdefault(number, [])
        at = bisect(own, match[1], key=lambda m: m[1])
        if (at == 0 or own[at - 1][2] <= match[1]) and (at == len(own) or match[2] <= own[at][1]):
            own.insert(at, match)
    return _sorted(list({match for own in kept.values() for match in own}))


def _last_row(piece: np.ndarray, text: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edits of the piece against the text by the diagonal on which the alignment ends; it begins anywhere."""
    steps = np.arange(high - low + 1)
    places = low + steps
    row = np.where((places >= 0) & (places <= len(text)), 0, len(piece) + 1)
    padded = np.concatenate([text, [0]])
    for i, c in enumerate(piece):
        at = places + i
        inside = (at >= 0) & (at < len(text))
        same = row + np.where(inside, padded[np.where(inside, at, -1)] != c, len(piece) + 1)
        row = np.minimum(same, np.append(row[1:], len(piece)) + 1)
        row = np.minimum.accumulate(row - steps) + steps
    return row


def align(piece: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of the piece on the diagonals low..high, within the budget."""
    size = len(piece)
    for diagonal in range(max(0, low), min(high, len(text) - size) + 1):
        if text[diagonal] == piece[0] and np.array_equal(text[diagonal : diagonal + size], piece):
            return diagonal, diagonal + size, 0
    low, high = low - budget, high + budget
    row = _last_row(piece, text, low, high)
    best = int(row.argmin())
    if row[best] > budget:
        return None
    end = min(len(text), low + best + size)
    # The same from behind, ending where the best alignment ends, gives its start.
    back = _last_row(piece[::-1], text[max(0, end - size - budget) : end][::-1], 0, budget)
    begin = end - size - int(back.argmin())
    return max(0, begin), end, int(row[best])


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where(F.col("text").isNotNull())


def blocks(benchmark: DataFrame, characters: int = BLOCK_CHARACTERS) -> Iterator[Broadcast]:
    """Items, one of each distinct text, with about `characters` in a block."""
    spark = benchmark.sparkSession
    items = _items(benchmark).groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = items.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    number = max(1, -(-size // characters))
    for k in range(number):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(number)) == k)
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])


def text_key(text: str) -> int:
    """What Spark's xxhash64 gives for the text."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


@lru_cache(maxsize=1)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    """An index whose matches name the key of a text."""
    return Index([(text_key(text), text) for _, text in items])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: every place where an item occurs in a document."""
    names = ["doc_id", "key", "start", "end", "edits"]

    def seek(items: Broadcast) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(tuple(items.value))
            for batch in small(batches):
                keys = batch.column("doc_id").to_pylist()
                rows = [(key, *m) for key, text in zip(keys, texts_of(batch)) for m in index.search(text)]
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return narrow(docs).mapInArrow(work, ", ".join(f"{n} long" for n in names))

    parts = [seek(items) for items in blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    owners = _items(benchmark).select(F.xxhash64("text").alias("key"), "item_id").distinct()
    return out.join(owners, "key").select("doc_id", "item_id", "start", "end", "edits")


def _holds_item(items: Broadcast) -> Column:
    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(tuple(items.value))
        for texts in parts:
            yield texts.fillna("").map(lambda t: bool(index.search(t))).astype(bool)

    return holds("text")


def kept_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for items in blocks(benchmark):
        docs = docs.where(~_holds_item(items))
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
