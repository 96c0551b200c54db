"""SimHash near-deduplication by exact comparison of tiles of fingerprints.

Fingerprints are compared as numbers, never as documents: equal ones are one node. A node
lies in the tile named by the population counts of its four 16-bit words. Two fingerprints
that differ in r bits have counts that differ by r in sum at most, so a pair of tiles whose
counts differ by more is skipped, and the others are compared in full by exclusive-or and
bit counts. A tile of many nodes is dealt into blocks of a bounded size. What a pair of
blocks links is handed on as one star per group, so a large group gives as many rows as it
has members, not as many as it has pairs. Stars are joined into classes by min-label
contraction over written tables.

Defined results: a null text is an empty text; texts without words have fingerprint zero
and are linked like any other. A null doc_id gets a row, but names no class unless all
members have none (then component_id is null). Repeated rows get a row each. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .common import narrow, roots, small, texts_of, without

SEED = 42
WORDS = 16  # bits of a word of the population counts
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits: each is set if it is set in over half of the hashes of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = min(shingle, len(words)) - 1
    starts = [0, *(ends[: len(ends) - last - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[last:].tolist())], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bits = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    return narrow(docs).mapInArrow(work, "doc_id long, fingerprint long")


def _tile(fingerprint: Column) -> Column:
    """The population counts of the four words, packed; two spare values keep sums in place."""
    counts = [
        F.bit_count(F.shiftrightunsigned(fingerprint, WORDS * k).bitwiseAND((1 << WORDS) - 1)).cast("int") + 8
        for k in range(4)
    ]
    return reduce(lambda a, b: a * 32 + b, counts)


def _steps(radius: int) -> list[int]:
    """Tile to tile within the radius, each direction once; 0 is the tile itself."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [sum(x * 32 ** (3 - k) for k, x in enumerate(d)) for d in near if d >= (0, 0, 0, 0)]


def _stars(radius: int):
    """Compares two blocks and yields one star per group that they link."""

    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.concatenate([a, b])
        left = right = np.empty(0, np.int64)
        step = max(1, (1 << 20) // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
            if len(i):
                label = roots(np.concatenate([left, i + at]), np.concatenate([right, j + len(a)]), len(nodes))
                right = np.flatnonzero(label != np.arange(len(nodes)))
                left = label[right]
        return nodes[left], nodes[right]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = [np.empty((2, 0), np.uint64)]
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (a, b))
                found = np.stack(stars(x, y))
                found = found[:, found[0] != found[1]]
                if found.size:
                    out.append(found)
            pairs = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return work


def links(nodes: DataFrame, radius: int = 2, block: int = 2048) -> DataFrame:
    """Links (a, b) that hold together exactly the fingerprints within `radius` bits.

    `nodes` has distinct fingerprints. At most 17^4 tiles exist, so their counts are of a
    bounded size whatever the input.
    """
    tiled = nodes.select("fingerprint", _tile(F.col("fingerprint")).alias("tile"))
    counts = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = tiled.join(F.broadcast(counts), "tile").select(
        "tile", "fingerprint", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int").alias("block")
    )
    blocks = cut(dealt.groupBy("tile", "block").agg(F.collect_list("fingerprint").alias("members")))
    steps = F.array(*[F.lit(s) for s in _steps(radius)])
    one = blocks.select(
        F.col("tile").alias("from"), F.col("block").alias("from_block"), F.col("members").alias("a"),
        F.explode(steps).alias("step"),
    ).withColumn("to", F.col("from") + F.col("step"))
    other = blocks.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("members").alias("b"))
    pairs = one.join(other, "to").where((F.col("step") != 0) | (F.col("from_block") <= F.col("to_block")))
    return pairs.select("a", "b").mapInArrow(_stars(radius), "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node each node reaches over the edges (a, b).

    Every round hangs each node's neighbours, and then each node itself, to the smallest
    neighbour, and is written before the next reads it. The rounds grow with the logarithm
    of a class's diameter; edges never grow in number.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(e: DataFrame) -> DataFrame:
        return cut(e.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        around = both(edges)
        large = cut(
            around.join(least(around), "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        low = least(large)
        edges = cut(
            large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), "low")
            .where(F.col("a") != F.col("low")).select("a", F.col("low").alias("b")).distinct()
        )
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (smallest doc_id reachable)."""
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    root = cut(contract(links(nodes, radius)))
    placed = cut(
        nodes.join(root, nodes.fingerprint == root.node, "left")
        .select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    )
    named = cut(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = cut(placed.join(named, "root").select("fingerprint", "component_id"))
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns.

    A decision is made for a doc_id: rows that share one go together. Rows without a doc_id
    stay, all of them, if some class has no other row; else they go.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(first).alias("kept"))
    return without(docs, cut(ids.where("NOT kept").select("doc_id")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
