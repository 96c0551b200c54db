"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Pieces of equal length are alike, and so are sequences with equal room, so the whole packing
follows from how many pieces there are of each length. Best fit takes the lengths from the
longest down; a segment tree over remaining capacities finds the tightest open room in
logarithmic time, and all sequences with that room take their pieces in one step: as many
each as fit, since a sequence that has just taken a piece is the tightest for the next one.
The result is that of best-fit decreasing over all pieces one by one, whatever their number.

The plan is a list of runs: from which rank on pieces of a length go to which sequences, how
many to each, and at which offset. Every length splits at most one stretch of like sequences
and opens at most two, so there are at most 2 * size stretches, and a sequence holds pieces
of at most sqrt(2 * size) different lengths: some 740,000 runs for 4096 tokens at the very
most, a few tens of thousands in practice. Only counts per length reach the driver.

The ranks are counted while the pieces are written, per task and length, and shifted by the
counts of the tasks before, so no length gathers in one place, be it a third of all pieces.

Defined results: a null text is an empty text, and an empty text has the end id alone. A
null doc_id is packed like any other. Repeated rows are packed each. An empty table gives no
rows. Which of several equally long pieces goes where follows the order of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut
from .common import narrow, small, texts_of
from .token_store import _definition, _encoder

SIZE = 4096
END_ID = 1
_RANKS = 1 << 48  # more than there are pieces of one length


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with slot and rank: where in its task's pieces of that length."""
    docs = narrow(docs)
    definition = _definition(docs.sparkSession, tokenizer_path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slot int, rank long"
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]
    schema += ", ids array<int>" if with_ids else ""
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, slot, seen = _encoder(definition.value), TaskContext.get().partitionId(), [0] * (size + 1)
        kind = f"<u{encoder.width}"
        for batch in small(batches):
            rows: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.append(np.frombuffer(encoder.encode(text), kind).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    line = (key, number, start, len(own), zlib.crc32(own.tobytes()), slot, seen[len(own)])
                    rows.append((*line, own.astype(np.int32)) if with_ids else line)
                    seen[len(own)] += 1
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.mapInArrow(work, schema)


class Rooms:
    """Stretches (first sequence, sequences) of like sequences by their room, and a segment tree over the rooms."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.open = [False] * (2 * self.leaves)
        self.stretches: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _mark(self, room: int, value: bool) -> None:
        node = self.leaves + room
        self.open[node] = value
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def add(self, room: int, first: int, sequences: int) -> None:
        if room and sequences:
            self.stretches[room].append((first, sequences))
            if len(self.stretches[room]) == 1:
                self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        stretch = self.stretches[room].pop()
        if not self.stretches[room]:
            self._mark(room, False)
        return stretch

    def tightest(self, least: int) -> int | None:
        """The smallest open room of at least `least`."""
        node = self.leaves + least
        while not self.open[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing over `counts` pieces per length: rows (length, rank, sequence, each, offset).

    From `rank` on, pieces of that length go `each` by `each` to sequences from `sequence` on,
    from `offset` on. Rows are in order of length and rank.
    """
    rooms, runs, opened = Rooms(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, number = 0, counts[length]
        while rank < number:
            room = rooms.tightest(length)
            if room is None:
                fresh = -(-(number - rank) // (size // length))
                rooms.add(size, opened, fresh)
                opened += fresh
                continue
            first, sequences = rooms.take(room)
            each = room // length
            full = min(sequences, (number - rank) // each)
            if full:
                runs.append((length, rank, first, each, size - room))
                rooms.add(room - each * length, first, full)
                rank, first, sequences = rank + full * each, first + full, sequences - full
            rest = number - rank
            if sequences and rest:  # fewer than a sequence takes
                runs.append((length, rank, first, rest, size - room))
                rooms.add(room - rest * length, first, 1)
                rank, first, sequences = number, first + 1, sequences - 1
            rooms.add(room, first, sequences)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _placed(ranked: DataFrame, runs: np.ndarray) -> DataFrame:
    """`ranked` with sequence_id and offset."""
    spark = ranked.sparkSession
    shared = spark.sparkContext.broadcast(runs)  # bounded by the size of a sequence, see above
    kept = [f.name for f in ranked.schema.fields if f.name not in ("slot", "rank")]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, each, offsets = shared.value.T
        starts = lengths * _RANKS + ranks
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(starts, length * _RANKS + rank, side="right") - 1
            step = rank - ranks[run]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept), pa.array(sequences[run] + step // each[run]),
                    pa.array(offsets[run] + step % each[run] * length),
                ],
                names=[*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    cut_up = cut(pieces(docs, tokenizer_path, end_id, size, with_ids))
    counts = cut_up.groupBy("slot", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    starts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    found = starts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length, `size` at most
    runs = plan({r["length"]: r["n"] for r in found}, size)
    ranked = cut_up.join(starts.drop("n"), ["slot", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return _placed(ranked.select(*cut_up.columns), runs)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, of pieces packed with their ids: sequence_id, doc_ids, ids, in order of offset."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # `size` ids at most
    rows = packed.groupBy("sequence_id").agg(held.alias("held"))
    return rows.select("sequence_id", F.col("held.doc_id").alias("doc_ids"), F.flatten("held.ids").alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
