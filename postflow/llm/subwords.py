"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model: the normaliser (blanks become a mark, one mark is
put in front), the pieces, and byte fallback for characters without a piece. Composed with
a text they give a lattice: an arc is a piece over a stretch of characters, a state is a
place together with the piece that ends there. The model's merges become weights: going on
from piece x with piece y costs nothing if merging x and y as one string gives exactly x
and y again, and infinity if not. Merging is local, so of all paths through the lattice
exactly one has a finite weight, and it is the segmentation by merges: the tropical shortest
path. Every prefix of a text has one finite path too, so a place has one state, and a search
that follows the longest arcs first never visits a place twice in vain.

No arc crosses two characters that stand side by side in no piece, so a text is composed in
parts between such places, and workers remember the paths of the parts they have met.

Models other than merge models (BPE) with an identity normaliser are refused.

Defined results: a null text is an empty text and has no ids; a null doc_id or a repeated
row gets a row like any other. Decoding gives the text back, but for the mark itself, which
becomes a blank as the model defines it. Texts of any length are read whole. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import narrow, small, texts_of

MARK = "▁"  # fixed value: what stands for a blank in pieces
# Parts, stretches and pairs a worker remembers; beyond it a memory starts anew.
MEMORY = 300_000
MAX_MODEL_BYTES = 64 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"


class Transducer(dict):
    """The compiled machines; as a mapping, parts of normalised texts to their packed ids."""

    def __init__(self, model: bytes):
        super().__init__()
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        if own.normalize(" Ⅳ  ﬁ\t") != f"{MARK}{MARK}Ⅳ{MARK}{MARK}ﬁ\t":
            raise ValueError("only an identity normaliser with a mark in front is compiled")
        size = own.get_piece_size()
        plain = [
            i for i in range(size)
            if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))
        ]
        self.ids = {own.id_to_piece(i): i for i in plain}
        self.weights = {own.id_to_piece(i): -own.get_score(i) for i in plain}
        self.bytes = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.spelled: list[bytes] = [b""] * size
        for piece, i in self.ids.items():
            self.spelled[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.finite: dict[tuple[str, str], bool] = {}
        # Pieces that merging cannot reach lie on no finite path.
        self.arcs = {p for p in self.ids if len(p) == 1 or self._merged(p) == [p]}
        # Lengths of the longer pieces that begin with three given characters, longest first.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for piece in sorted(self.arcs, key=len, reverse=True):
            if len(piece) > 2 and len(piece) not in self.lengths.get(piece[:3], ()):
                self.lengths[piece[:3]] = (*self.lengths.get(piece[:3], ()), len(piece))
        self.paths: dict[str, bytes] = {}
        self.parts = self._cutter()

    def _cutter(self) -> re.Pattern:
        """Cuts a normalised text where it costs one pass: before marks, and between letters and
        those ASCII signs that no piece has beside a letter."""
        letters = re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x180))))
        signs = [chr(c) for c in range(0x80) if not chr(c).isalpha()]
        signs = [c for c in signs if not any(c + x in self.inner or x + c in self.inner for x in letters)]
        rest = f"{MARK}*[^{MARK}]+|{MARK}+"
        if not signs:
            return re.compile(rest)
        s = re.escape("".join(signs))
        return re.compile(f"{MARK}{MARK}+[^{MARK}]*|{MARK}?(?:[{_LETTERS}]++|[{s}]++)(?=[{MARK}{_LETTERS}{s}]|\\Z)|{rest}")

    def _merged(self, text: str) -> list[str]:
        """Merges neighbours whose union is a piece, lightest first, then leftmost."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and (weight := self.weights.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (weight, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _goes_on(self, x: str, y: str) -> bool:
        """Whether the weight of y after x is finite."""
        found = self.finite[x, y] = self._merged(x + y) == [x, y]
        return found

    def _from(self, text: str, at: int) -> Iterator[str]:
        """The arcs that leave a place, longest first; the last is a character or its bytes."""
        for length in self.lengths.get(text[at : at + 3], ()):
            if (arc := text[at : at + length]) in self.arcs and len(arc) == length:
                yield arc
        if (arc := text[at : at + 2]) in self.arcs:
            yield arc
        if len(arc) == 2 or arc not in self.arcs:
            yield text[at]

    def _shortest(self, text: str) -> list[str]:
        """The one path of finite weight over a stretch, longest arcs first; a place that leads
        nowhere is not tried again."""
        path, finite, size = [""], self.finite, len(text)
        at, dead, leaving = 0, set(), [self._from(text, 0)]
        while at < size:
            last = path[-1]
            for arc in leaving[-1]:
                end = at + len(arc)
                if end in dead:
                    continue
                known = finite.get((last, arc)) if at else True
                if known or known is None and self._goes_on(last, arc):
                    path.append(arc)
                    if end < size:
                        leaving.append(self._from(text, end))
                    at = end
                    break
            else:
                dead.add(at)
                leaving.pop()
                at -= len(path.pop())
        return path[1:]

    def _spell(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def _stretches(self, part: str) -> Iterator[str]:
        start = 0
        for k in range(1, len(part)):
            if part[k - 1 : k + 1] not in self.inner:
                yield part[start:k]
                start = k
        yield part[start:]

    def __missing__(self, part: str) -> bytes:
        paths = []
        for stretch in self._stretches(part):
            path = self.paths.get(stretch)
            if path is None:
                ids = [i for piece in self._shortest(stretch) for i in self._spell(piece)]
                path = self.paths[stretch] = array("i", ids).tobytes()
            paths.append(path)
        found = self[part] = b"".join(paths)
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.empty(0, np.int32)
        for memory in (self, self.paths, self.finite):
            if len(memory) > MEMORY:
                memory.clear()
        normal = MARK + text.replace(" ", MARK)
        return np.frombuffer(b"".join(map(self.__getitem__, self.parts.findall(normal))), np.int32)

    def forget(self) -> None:
        for memory in (self, self.paths, self.finite):
            memory.clear()

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell, without the blank that was put in front."""
        spelled = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return spelled.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _transducer(model: bytes) -> Transducer:
    return Transducer(model)


def load_model(spark: SparkSession, path: str) -> Broadcast:
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than a model should be")
    with open(path, "rb") as source:
        return spark.sparkContext.broadcast(source.read())


def encode_documents(docs: DataFrame, model: Broadcast, remember: bool = True) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32 (ids as little-endian 32 bits), decoded_sha256, round_trip.

    What a worker remembers saves time in its next task, but lies beside all that the session runs later.
    """
    names = ["doc_id", "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model.value)
        for batch in small(batches):
            texts = texts_of(batch)
            ids = [transducer.encode(t) for t in texts]
            back = [transducer.decode(i) for i in ids]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                    pa.array([b == t.replace(MARK, " ") for b, t in zip(back, texts)], pa.bool_()),
                ],
                names=names,
            )
        if not remember:
            transducer.forget()

    schema = "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return narrow(docs).mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, model: Broadcast) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(model.value)
        for batch in small(batches):
            texts = [transducer.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = load_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
