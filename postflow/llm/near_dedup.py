"""Near-deduplication by SimHash and exact Jaccard similarity of the sets of five-word shingles.

SimHash comes first: fingerprints over five-word shingles are compared by the tiles of `simhash`,
and what they link is checked by the whole sets. At `RADIUS` bits that finds texts that are nearly
alike, so large groups of them are one class before anything else is done, but not all similar
ones. The rest is found by an exact way, a prefix filter, over all that then lie in different classes.

Two texts are linked if their sets have a similarity of at least `SIMILAR`, a whole fraction.
Such sets share one of the first n - ceil(SIMILAR * n) + 1 shingles of each, n being its size,
in any order that is the same for all texts. So only texts that meet at one of these shingles
are compared, and no linked pair is missed. Of each set a parity of `BITS` bits is kept: two
parities differ in no more bits than the sets in shingles, so a pair whose parities differ in
more than similar sets can is dropped. The parity folded to `MARK` bits stands beside each
shingle, so texts that meet at a common one and are unlike make no pair at all: only sets of
some hundred shingles and more are too large for it. What is left, long texts above all, is put to parities
of at least `FINE` bits per shingle, of which the finer is folded to the width of the other;
they tell nearly all unlike sets apart at a sixteenth of the sets' size. Every pair that is
still there is settled by the whole sets.

Rare shingles come first in the order, so common lines and passages seldom bring texts
together. Which are common is told by a sample, a fixed share of a large table: were it of a fixed
size, a shingle that it does not show could stand in more texts the larger the table is. It changes
the work, not the result. Shingles that the very same texts have in their prefixes, as those of
one passage do, bring the same pairs together, so only the first of them in the order is kept. Texts that meet at one shingle are first compared with one of them, a pivot, so a
large group of near copies gives as many pairs as it has members. When such a round links
fewer than `MANY` pairs, all that still lie in different classes are compared.

(For fingerprints of 64 bits to find every pair of this similarity they would have to be compared
within some 18 bits; at that radius no two tiles of `simhash` can be told apart.)

Defined results: a null text is an empty text; texts without words are linked with each other.
Words are parted by ASCII blanks, and A-Z count as a-z; a text of fewer words than a shingle
is one shingle. A null doc_id names no class unless all members have none (then component_id
is null). Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, discard
from .common import narrow, small, texts_of, without
from .quality import WordHashes
from .simhash import SEED, contract, fingerprint, links as tile_links

SHINGLE = 5
SIMILAR = (4, 5)
MANY = 10_000  # links of a round that make another round with pivots worth while
BITS = 1024
MARK = 512
RADIUS = 2  # bits in which fingerprints differ that are compared first
MEMORY = 100_000  # words that a worker remembers
FINE = 4
SAMPLE = 5_000  # documents that tell which shingles are common, at least
SHARE = 0.1  # of the documents of a large table that tell it
COMMON = 5  # of them that hold a common shingle
LISTED = 1_000_000  # common shingles that are known to the order, the most common ones
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    if len(hashes) > MEMORY:
        hashes.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    size = len(words) - width + 1 if words else 0
    found = np.full(size, width, np.uint64)
    for k in range(width):
        found = found * _FACTOR + one[k : k + size]
    found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(found ^ (found >> np.uint64(32)))


def name_of(found: np.ndarray) -> int:
    """Equal sets are one node."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set shares one, the rarest of the set, in order."""
    times = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        times = np.where(common[at] == found, counts[at], 0)
    part, whole = SIMILAR
    most = len(found) - -(-len(found) * part // whole) + 1
    return found[np.lexsort((found, times))[:most]]


def parity(found: np.ndarray, bits: int = BITS) -> bytes:
    """Per slot of the hashes, whether the set has an odd number there."""
    return np.packbits(np.bincount(found % np.uint64(bits), minlength=bits) & 1).tobytes()


def folded(bits: bytes) -> np.ndarray:
    """A parity at the width of `MARK` bits, as words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, MARK // 64))


def fine_parity(found: np.ndarray) -> bytes:
    """A parity as wide as the set is large: a power of two."""
    return parity(found, max(BITS, 1 << (FINE * len(found)).bit_length()))


def _differ(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ at the width of the narrower one."""
    one, two = sorted((np.frombuffer(v, np.uint64) for v in (x, y)), key=len)
    while len(two) > len(one):
        two = two[: len(two) // 2] ^ two[len(two) // 2 :]
    return int(np.bitwise_count(one ^ two).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity, reckoned in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - shared)


def _longs(values: list[np.ndarray] | list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.empty(0, np.uint64), *values])))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of a sample, sorted, and how many of its documents hold each."""
    rows = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("shingles")), F.lit(1 << 30)) / (1 << 30)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            found = np.concatenate([np.empty(0, np.uint64), *(shingles(t, hashes) for t in texts_of(batch))])
            yield pa.RecordBatch.from_arrays([_longs(found)], names=["shingle"])

    sample = docs.where(draw < min(1.0, max(SHARE, SAMPLE / max(1, rows)))).select("text")
    held = sample.mapInArrow(work, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = held.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(LISTED).toArrow()
    keys = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def _prefixes(docs: DataFrame, common: Broadcast) -> DataFrame:
    """doc_id, node, size of its set, prefix, parity, mark, fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            texts = texts_of(batch)
            sets = [shingles(t, hashes) for t in texts]
            parities = [parity(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), _longs([name_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()),
                    _lists([prefix(s, *common.value) for s in sets]), pa.array(parities, pa.binary()),
                    _lists([folded(p) for p in parities]), _longs([fingerprint(t, SHINGLE) for t in texts]),
                ],
                names=["doc_id", "node", "size", "prefix", "parity", "mark", "fingerprint"],
            )

    return docs.mapInArrow(
        work, "doc_id long, node long, size int, prefix array<long>, parity binary, mark array<long>, fingerprint long"
    )


def _held(docs: DataFrame, rows: DataFrame, nodes: DataFrame, of: Callable[[np.ndarray], bytes]) -> DataFrame:
    """node, size, held: `of` the whole set of each of `nodes`, read from one text of it."""
    ids = cut(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            sets = [shingles(t, hashes) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    _longs([name_of(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([of(s) for s in sets], pa.binary()),
                ],
                names=["node", "size", "held"],
            )

    read = docs.join(ids, docs.doc_id.eqNullSafe(ids["_id"]), "left_semi").select("text")
    held = read.mapInArrow(work, "node long, size int, held binary").join(nodes, "node", "left_semi")
    return cut(held.dropDuplicates(["node"]))


def _settled(pairs: DataFrame, held: DataFrame, same: Callable[[bytes, bytes, int], bool]) -> DataFrame:
    """The pairs whose two values pass `same`, which is also told the sum of the sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "sizes")))
            yield batch.select(["a", "b"]).filter(pa.array([same(*row) for row in rows], pa.bool_()))

    one = held.select(F.col("node").alias("a"), F.col("held").alias("x"), F.col("size").alias("x_size"))
    two = held.select(F.col("node").alias("b"), F.col("held").alias("y"), F.col("size").alias("y_size"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.select("a", "b", "x", "y", (F.col("x_size") + F.col("y_size")).cast("long").alias("sizes"))
    return both.mapInArrow(work, "a long, b long")


WORDS = [f"mark{k}" for k in range(MARK // 64)]
ENTRY = ["node", "size", "place", *WORDS]


def _can_be(x: str, y: str) -> Column:
    """Whether two sets that meet here first can be similar, by what is left of them and by their marks."""
    left = F.least(*(F.col(f"{e}.size") - F.col(f"{e}.place") for e in (x, y)))
    sizes = F.col(f"{x}.size").cast("long") + F.col(f"{y}.size")
    differ = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in WORDS), F.lit(0))
    return (left * sum(SIMILAR) >= sizes * SIMILAR[0]) & _near(differ, sizes)


def _meetings(placed: DataFrame, turn: int, last: bool) -> DataFrame:
    """Pairs (a, b) that meet at a shingle and lie in different classes: with a pivot, or all at last."""
    parts = placed.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(
        parts.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1").select("shingle", "main")
    )
    among = cut(placed.join(mixed, "shingle"))
    meet = (F.col("x.root") != F.col("y.root")) & _can_be("x", "y")
    if not last:
        entry = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), *ENTRY, "root")
        other = cut(
            among.where("root = main").groupBy("shingle").agg(F.min(entry).alias("pivot")).select("shingle", "pivot.*").drop("draw")
        )
    else:
        other = among
        # Two entries outside the main class would meet from both sides.
        meet = meet & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    pairs = among.where("root <> main").alias("x").join(other.alias("y"), "shingle").where(meet)
    # Written before it is made distinct: on its own, Spark can split the join of a hot shingle.
    pairs = cut(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
    found = cut(pairs.distinct())
    discard(mixed, among, other, pairs)
    return found


def _possible(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose parities do not rule out that the sets are similar."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    marks = cut(rows.select("node", "size", "parity").join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y")
            )
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_near(differ, batch.column("sizes").to_numpy())))

    one = marks.select(F.col("node").alias("a"), F.col("parity").alias("x"), F.col("size").alias("x_size"))
    two = marks.select(F.col("node").alias("b"), F.col("parity").alias("y"), F.col("size").alias("y_size"))
    both = pairs.join(one, "a").join(two, "b")
    both = both.select("a", "b", "x", "y", (F.col("x_size") + F.col("y_size")).cast("long").alias("sizes"))
    found = cut(both.mapInArrow(work, "a long, b long"))
    discard(marks, pairs)
    return found


def _near(differ, sizes):
    """Similar sets differ in the share (whole - part) / (whole + part) of their sizes at most."""
    return differ * sum(SIMILAR) <= sizes * (SIMILAR[1] - SIMILAR[0])


def _nodes(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    pairs = _possible(rows, pairs)
    nodes = _nodes(pairs)
    fine = _held(docs, rows, nodes, fine_parity)
    left = cut(_settled(pairs, fine, lambda x, y, sizes: _near(_differ(x, y), sizes)))
    discard(pairs, nodes, fine)
    nodes = _nodes(left)
    sets = _held(docs, rows, nodes, np.ndarray.tobytes)
    found = cut(_settled(left, sets, lambda x, y, _: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
    discard(left, nodes, sets)
    return found


def _firsts(entries: DataFrame) -> DataFrame:
    """Of shingles that the same nodes have the one that comes first in the order, told by 128 bits over the nodes."""
    hashes = [F.xxhash64("node"), F.xxhash64("node", F.lit(1))]
    nodes = entries.groupBy("shingle").agg(
        F.min(F.struct("node", "place")).alias("least"), F.count(F.lit(1)).alias("n"),
        *(F.bit_xor(h).alias(f"bits{k}") for k, h in enumerate(hashes)),
    )
    alike = nodes.groupBy("least.node", "n", "bits0", "bits1")
    return cut(alike.agg(F.min_by("shingle", "least.place").alias("shingle")).select("shingle"))


def _shared(rows: DataFrame) -> DataFrame:
    """The entries of prefixes at shingles that several nodes have there, once for the same nodes: shingle, node, size, place, mark words."""
    entries = rows.select("node", "size", F.posexplode("prefix").alias("place", "shingle"))
    met = cut(
        entries.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("shingle")
    )
    found = cut(entries.join(met, "shingle").dropDuplicates(["shingle", "node"]))
    words = [F.col("mark")[k].alias(w) for k, w in enumerate(WORDS)]
    marks = rows.select("node", *words).dropDuplicates(["node"])
    firsts = _firsts(found)
    shared = cut(found.join(firsts, "shingle").join(marks, "node").select("shingle", *ENTRY))
    discard(met, found, firsts)
    return shared


def _sketched(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets that SimHash brings together: each with the first of its fingerprint, and these along the tiles' links."""
    nodes = rows.select("fingerprint", "node").distinct()
    chiefs = cut(nodes.groupBy("fingerprint").agg(F.min("node").alias("chief")))
    x = chiefs.select(F.col("fingerprint").alias("a"), F.col("chief").alias("x"))
    y = chiefs.select(F.col("fingerprint").alias("b"), F.col("chief").alias("y"))
    between = tile_links(chiefs.select("fingerprint"), radius).join(x, "a").join(y, "b").select("x", "y")
    within = nodes.join(chiefs, "fingerprint").where("node <> chief").select(F.col("chief").alias("x"), F.col("node").alias("y"))
    found = cut(between.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(chiefs)
    return found


def near_duplicates(docs: DataFrame, many: int = MANY) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable)."""
    docs = narrow(docs)
    wide = cut(_prefixes(docs, docs.sparkSession.sparkContext.broadcast(_common(docs))))
    shared = _shared(wide)
    rows = cut(wide.drop("prefix", "mark"))
    discard(wide)
    links = _verified(docs, rows, _sketched(rows))
    root, turn, last = cut(contract(links)), 0, False
    while True:
        placed = shared.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = _verified(docs, rows, _meetings(placed, turn, last))
        links = links.unionByName(found)
        root = cut(contract(links))
        if last:
            break
        turn, last = turn + 1, found.count() < many
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    placed = cut(nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = cut(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = cut(placed.join(named, "root").select("node", "component_id"))
    return rows.join(classes, "node").select("doc_id", "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns.

    A decision is made for a doc_id: rows that share one go together. Rows without a doc_id
    stay, all of them, if some class has no other row; else they go.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(first).alias("kept"))
    return without(docs, cut(ids.where("NOT kept").select("doc_id")))
