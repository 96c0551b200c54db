"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes two tries with a shared tail: pieces that begin a word, and pieces
that continue one. A node's failure link leads to where matching goes on once the longest
piece that starts here is cut off, and each link knows how many pieces it pops. A word is
then read once, character by character, adding up popped pieces; no piece is ever built.

A word is a run of characters other than [\\x20\\x09-\\x0D]. A word that no sequence of
greedy pieces covers counts as one unknown token.

Defined results: a null text is an empty text and has no words; a null doc_id or a repeated
row gets a row like any other. Words and texts of any length are read whole. An empty table
gives no rows.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import narrow, small, texts_of

BEGIN = "▁"  # fixed value: how the vocabulary marks a piece that begins a word
# Words whose length a worker remembers; beyond it the memory starts anew.
MEMORY = 500_000
MAX_VOCABULARY_BYTES = 64 << 20
UNKNOWN = -1


class LongestMatch:
    """The automaton. Nodes are numbers; `next` holds one edge table per node."""

    def __init__(self, begin: Iterable[str], inside: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.begin, self.inside = 0, 1
        ends = set()
        for root, pieces in ((self.begin, begin), (self.inside, inside)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                    node = self.next[node][c]
                if node != root:
                    ends.add(node)
        self.fail = [UNKNOWN] * len(self.next)
        self.pops = [0] * len(self.next)
        # Nearer nodes first: a node's link is made from those of shorter strings.
        line = deque((r, c, n) for r in (self.begin, self.inside) for c, n in self.next[r].items())
        while line:
            parent, c, node = line.popleft()
            if node in ends:
                self.fail[node], self.pops[node] = self.inside, 1
            else:
                at, popped = self.fail[parent], self.pops[parent]
                while at != UNKNOWN and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != UNKNOWN:
                    self.fail[node], self.pops[node] = self.next[at][c], popped
            line.extend((node, d, n) for d, n in self.next[node].items())

    def length(self, word: str) -> int:
        """Pieces of the word, or UNKNOWN."""
        node, count = self.begin, 0
        for c in word:
            while c not in self.next[node]:
                count += self.pops[node]
                node = self.fail[node]
                if node == UNKNOWN:
                    return UNKNOWN
            node = self.next[node][c]
        while node != self.inside:
            if self.fail[node] == UNKNOWN:
                return UNKNOWN
            count += self.pops[node]
            node = self.fail[node]
        return count


class Counter(dict):
    """Word (bytes) to pieces, found on first use."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.automaton.length(word.decode())
        return found


@lru_cache(maxsize=2)
def _counter(begin: tuple[str, ...], inside: tuple[str, ...]) -> Counter:
    return Counter(LongestMatch(begin, inside))


def count_text(counter: Counter, text: str) -> tuple[int, int, int]:
    """Words, tokens and unknown words of a text."""
    words = text.encode().split()
    if len(counter) > MEMORY:
        counter.clear()
    lengths = np.fromiter(map(counter.__getitem__, words), np.int64, len(words))
    unknown = int(np.count_nonzero(lengths == UNKNOWN))
    return len(words), int(lengths.sum()) + 2 * unknown, unknown


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """(begin, inside) pieces of a sentencepiece model; control and byte pieces match no text."""
    import os

    import sentencepiece

    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary should be")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    begin = tuple(p[1:] for p in pieces if p.startswith(BEGIN) and len(p) > 1)
    return spark.sparkContext.broadcast((begin, tuple(p for p in pieces if BEGIN not in p)))


def token_counts(docs: DataFrame, pieces: Broadcast) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown; unknown words count one token each."""
    names = ["doc_id", "n_words", "n_tokens", "n_unknown"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*pieces.value)
        for batch in small(batches):
            rows = [count_text(counter, t) for t in texts_of(batch)]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=names
            )

    return narrow(docs).mapInArrow(work, ", ".join(f"{n} long" for n in names))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces)
