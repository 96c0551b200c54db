"""Token ids as raw binary shards with a minimal perfect hash index.

A shard holds the ids of documents in ascending doc_id, back to back, as little-endian
unsigned numbers of the narrowest width that holds the vocabulary (2 or 4 bytes); behind
them stand the doc_ids, the place of each document and a tail with the counts. Index files
hold, for the keys of one hash bucket, a minimal perfect hash and per slot the key's
fingerprint and where its ids lie: shard, place, documents, ids. A look-up reads one index
slot and one stretch of one shard, whatever the number of documents.

Files are named after the attempt that wrote them and only become part of the store
through the written table that names them, so a task that runs twice does no harm.

Defined results: a null text is an empty text, and an empty text has the end id alone. A
null doc_id is written before all others and is not indexed. Repeated rows are written
each, in the order of their ids, and share an index slot. An empty table gives a store
without shards.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ..session import cut, working_folder
from .common import content, narrow, small, texts_of
from .mph import PerfectHash, fingerprints

MAGIC = b"TIDS\x01\x00\x00\x00"
TAIL = "<8sQQQ"  # magic, bytes of an id, documents, ids
# Parts whose ids a worker remembers; beyond it the memory starts anew.
MEMORY = 1_200_000
MAX_TOKENIZER_BYTES = 64 << 20


# Fixed value: how a definition splits and lower-cases texts for which runs can be taken apart.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Latin letters that lower-case to one letter, which no normal form changes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SIGNS = r"\x21-\x26\x28-\x40\x5b-\x60\x7b-\x7e"  # ASCII without the apostrophe, which binds letters
_SIMPLE = re.compile(rf"[{_LETTERS}{_SIGNS}\x20\x09-\x0d]*")
_WORD = re.compile(f"[{_LETTERS}]+")
_PARTS = re.compile(rf"[{_LETTERS}]+|[{_SIGNS}]+")


class Encoder(dict):
    """Ids of whole texts by the tokenizers library, remembered part by part.

    The tokenizer drops white space and no token crosses it, so the ids of a text are the
    ids of its runs of non-blanks. Where the definition also splits at letters, a text of
    Latin letters and ASCII signs comes apart there too: signs go through the whole
    tokenizer, lower-cased words through its model alone.
    """

    def __init__(self, definition: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.splits = self._splits(json.loads(definition))
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = filter(re.compile(f"[{_LETTERS}]").match, map(chr, range(0x180)))
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in letters})

    @staticmethod
    def _splits(definition: dict) -> bool:
        normal = [n["type"] for n in (definition["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (definition["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            normal == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": KNOWN_SPLIT}
            and first["invert"] and first["behavior"] == "Removed"
            and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
            and definition["model"]["type"] == "BPE"
        )

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def __missing__(self, part: str) -> bytes:
        if self.splits and part.islower() and _WORD.fullmatch(part):
            spelled = part if part.isascii() else part.translate(self.spelling)  # ASCII spells itself
            ids = self._pack([t.id for t in self.tokenizer.model.tokenize(spelled)])
        else:
            ids = self._pack(self.tokenizer.encode(part, add_special_tokens=False).ids)
        self[part] = ids
        return ids

    def _apart(self, text: str) -> list[str]:
        if self.splits and _SIMPLE.fullmatch(text) and "<|" not in text:
            return _PARTS.findall(text.lower())
        return [run.decode() for run in text.encode().split()]

    def encode(self, text: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        return b"".join(map(self.__getitem__, self._apart(text)))


@lru_cache(maxsize=2)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Store:
    """`shards` (shard, file, start, documents, ids) and `index` (bucket, file) are written tables."""

    folder: str
    shards: DataFrame
    index: DataFrame
    unkeyed: DataFrame
    buckets: int
    width: int


def _shard_writer(folder: str, width: int):
    kind = np.dtype(f"<u{width}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        unpack = zstandard.ZstdDecompressor()
        shard, out, name, ids, rows = None, None, "", 0, []

        def close() -> pa.RecordBatch:
            keys = np.array([k or 0 for k, _, _ in rows], np.int64)
            places = np.array([p for _, p, _ in rows] + [ids], np.uint64)
            out.write(keys.tobytes() + places.tobytes() + struct.pack(TAIL, MAGIC, width, len(rows), ids))
            out.close()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()),
                    pa.array(range(len(rows)), pa.int64()), pa.array([p for _, p, _ in rows], pa.int64()),
                    pa.array([n for _, _, n in rows], pa.int64()), pa.array([name] * len(rows), pa.string()),
                ],
                names=["doc_id", "shard", "row", "place", "n_tokens", "file"],
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "doc_id", "ids"))
            for number, key, packed in zip(*(c.to_pylist() for c in columns)):
                if number != shard:
                    if out:
                        yield close()
                    shard, name, ids, rows = number, f"shard-{number:06d}-{uuid.uuid4().hex}.ids", 0, []
                    out = files.open_output_stream(f"{root}/{name}")
                payload = unpack.decompress(packed)
                out.write(payload)
                count = len(payload) // kind.itemsize
                rows.append((key, ids, count))
                ids += count
        if out:
            yield close()

    return work


def _index_writer(folder: str):
    def work(table: pa.Table) -> pa.Table:
        files, root = _files(folder)
        keys = table.column("doc_id").to_numpy()
        hashed = PerfectHash.build(keys)
        slot = hashed.numbers(keys)
        bucket = table.column("bucket")[0].as_py()
        name = f"index-{bucket:06d}-{uuid.uuid4().hex}.mph"
        with io.BytesIO() as held, files.open_output_stream(f"{root}/{name}") as out:
            hashed.save(held)
            marks = np.empty(len(keys), np.uint32)
            marks[slot] = fingerprints(keys)
            np.save(held, marks)
            for column in ("shard", "row", "place", "documents", "n_tokens"):
                values = np.empty(len(keys), np.int64)
                values[slot] = table.column(column).to_numpy()
                np.save(held, values)
            out.write(held.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "file": pa.array([name])})

    return work


class IndexBucket:
    """One index file: keyed access in constant time."""

    def __init__(self, folder: str, name: str):
        files, root = _files(folder)
        with files.open_input_file(f"{root}/{name}") as source:
            held = io.BytesIO(source.read())
        self.hashed = PerfectHash.load(held)
        self.marks, self.shard, self.row, self.place, self.documents, self.n_tokens = (np.load(held) for _ in range(6))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held (but for fingerprints that coincide) and their slots."""
        if not self.hashed.size:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        slot = self.hashed.numbers(keys)
        return (slot >= 0) & (self.marks[slot] == fingerprints(keys)), np.maximum(slot, 0)


class ShardFile:
    """One shard, open for reading."""

    def __init__(self, folder: str, name: str):
        files, root = _files(folder)
        self.source = files.open_input_file(f"{root}/{name}")
        size, tail = self.source.size(), struct.calcsize(TAIL)
        magic, self.width, self.documents, self.ids = struct.unpack(TAIL, self.source.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shard of token ids")

    def places(self, row: int, documents: int) -> np.ndarray:
        """Where `documents` documents from `row` on begin, and where the last one ends."""
        at = self.ids * self.width + 8 * (self.documents + row)
        return np.frombuffer(self.source.read_at(8 * (documents + 1), at), np.uint64).astype(np.int64)

    def key(self, row: int) -> int:
        return int(np.frombuffer(self.source.read_at(8, self.ids * self.width + 8 * row), np.int64)[0])

    def read(self, place: int, count: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(count * self.width, place * self.width), f"<u{self.width}")


def _definition(spark: SparkSession, path: str) -> Broadcast:
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than a tokenizer definition should be")
    with open(path, encoding="utf-8") as source:
        return spark.sparkContext.broadcast(source.read())


def _bounds(docs: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first doc_id of every shard but the first: one number per file that will be written."""
    size = docs.agg(F.sum(F.octet_length(content())).alias("b")).first()["b"] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-size // shard_bytes))
    if shards == 1:
        return np.empty(0, np.int64)
    steps = F.array(*[F.lit(k / shards) for k in range(1, shards)])
    found = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 20 * shards))).first()[0]
    return np.unique(np.array(found or [], np.int64))


def write_store(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None,
    shard_bytes: int = 256 << 20, bucket_keys: int = 1 << 16,
) -> Store:
    """Encodes every text and writes shards and index into `folder`.

    `shard_bytes` is the text that a shard takes at most on average; there are as many shards
    as shuffle partitions at least. Ids go to their shard packed, since a shuffle of texts or
    raw ids would be twice the size.
    """
    spark = docs.sparkSession
    folder = folder or working_folder(spark, "token-store")
    _files(folder)[0].create_dir(_files(folder)[1], recursive=True)
    docs = narrow(docs)
    bounds, definition = _bounds(docs, shard_bytes), _definition(spark, tokenizer_path)
    width = Encoder(definition.value).width
    ending = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(definition.value), zstandard.ZstdCompressor(level=1)
        for batch in small(batches):
            keys = batch.column("doc_id")
            shard = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            ids = [pack.compress(encoder.encode(t) + ending) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), keys, pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"]
            )

    encoded = docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(
        "shard", F.asc_nulls_first("doc_id"), "ids"
    )
    written = cut(
        ordered.mapInArrow(
            _shard_writer(folder, width), "doc_id long, shard int, row long, place long, n_tokens long, file string"
        )
    )
    totals = written.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = cut(totals.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))))  # a row per file

    keyed = written.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("shard").alias("shard"), F.min("row").alias("row"), F.min("place").alias("place"),
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"),
    )
    buckets = max(16, -(-written.count() // bucket_keys))
    index = cut(
        keyed.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
        .applyInArrow(_index_writer(folder), "bucket int, file string")
    )
    return Store(folder, shards, index, written.where("doc_id IS NULL"), buckets, width)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def look_up(store: Store, keys: DataFrame) -> DataFrame:
    """Where the ids of each key lie: doc_id, shard, row, place, documents, n_tokens.

    `keys` are distinct. Every bucket's keys meet its index file in one task, whose size is
    that of the bucket. A key that the store does not hold gives no row.
    """
    folder = store.folder
    named = {r["bucket"]: r["file"] for r in store.index.collect()}  # a row per index file

    def work(table: pa.Table) -> pa.Table:
        wanted = table.column("doc_id").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        columns = ("shard", "row", "place", "documents", "n_tokens")
        if bucket not in named:
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", *columns)})
        index = IndexBucket(folder, named[bucket])
        held, slot = index.find(wanted)
        slot = slot[held]
        return pa.table({"doc_id": pa.array(wanted[held]), **{c: pa.array(getattr(index, c)[slot]) for c in columns}})

    return keys.select("doc_id").withColumn("bucket", _bucket(store.buckets)).groupBy("bucket").applyInArrow(
        work, "doc_id long, shard long, row long, place long, documents long, n_tokens long"
    )


def read_documents(store: Store, found: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document at the places `found`, from the shards.

    A key whose fingerprint coincided with a stored one is told apart by the key in the shard.
    """
    folder = store.folder
    shards = {r["shard"]: (r["file"], r["start"]) for r in store.shards.collect()}  # a row per file
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, start = None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for key, at, row, documents in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "row", "documents"))):
                if at != number:
                    number, (name, start) = at, shards[at]
                    shard = ShardFile(folder, name)
                if key is not None and shard.key(row) != key:
                    continue
                places = shard.places(row, documents)
                ids = shard.read(int(places[0]), int(places[-1] - places[0])).astype("<u4")
                for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
                    own = ids[a - int(places[0]) : b - int(places[0])]
                    line = (key, start + a, b - a, zlib.crc32(own.tobytes()))
                    rows.append((*line, own.astype(np.int32)) if with_ids else line)
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    places = found.select("doc_id", "shard", "row", "documents").unionByName(
        store.unkeyed.select("doc_id", F.col("shard").cast("long"), "row", F.lit(1).cast("long").alias("documents"))
    )
    dealt = places.repartitionById(max(1, len(shards)), F.col("shard").cast("int")).sortWithinPartitions("shard", "row")
    return dealt.mapInArrow(work, schema)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    keys = narrow(docs).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return read_documents(store, look_up(store, keys))
