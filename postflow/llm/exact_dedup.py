"""Exact deduplication through the disk-backed state of a streaming query.

Digests land as a narrow table. A streaming aggregation over it keeps, per digest and
without expiry, a stable identifier, the locator of its content, a count and the row that
stays; the state lies in RocksDB, and its checkpoint in the shared folder, so a lost
executor costs a reload. `keep_id` and `group_size` are read from that state. A digest that
is already known is a hit, and a hit is only believed after the full bytes of both texts
were compared: the first one is found by its identifier and locator. Texts that differ
under one digest go into another round with a digest of their own round; the count and the
row that stays of a digest they leave are taken from its remaining rows instead.

Defined results: a null text is an empty text; empty texts are equal to each other. A
null doc_id is a value like any other and comes last. A repeated row (same doc_id, equal
text) counts in `group_size`, and all its rows share its decision. An empty table gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut, working_folder
from .common import BLANKS, content, narrow, without

STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store per partition would otherwise set aside megabytes, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # An open store holds over a megabyte of native memory, so an executor with many partitions closes each after its batch.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
Digest = Callable[[Column, int], Column]


def normalised() -> Column:
    return F.regexp_replace(content(), BLANKS, "")


def sha256_digest(text: Column, turn: int) -> Column:
    """SHA-256 of the UTF-8 bytes; later rounds hash another prefix, so a collision parts."""
    return F.sha2((text if turn == 0 else F.concat(F.lit(f"{turn}\x00"), text)).cast("binary"), 256)


@contextmanager
def _on_disk(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in STATE_ON_DISK}
    for key, value in STATE_ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _best() -> Column:
    """The row that stays of a group: the most code points, then the smallest doc_id, null last."""
    return F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("back"))).alias("best")


def _kept(best: Column) -> Column:
    return F.bitwise_not(best["back"])


def keyed_state(landed: DataFrame, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Runs the stream over the landed digests in `folder` and returns (digest, rep_id, locator, rows, keep_id).

    `arrival` orders landings: a digest keeps the identifier of its first one, while `keep_id`
    follows the longest text. Running again over a folder that has grown goes on from the
    stored state.
    """
    spark = landed.sparkSession
    seen = f"{folder}/seen"

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{seen}/batch={number}")

    source = spark.readStream.schema(landed.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = source.parquet(f"{folder}/landed").groupBy("digest").agg(
        F.min(F.struct("arrival", "doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("rows"), _best()
    )
    with _on_disk(spark):
        query = (
            state.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    changes = spark.read.schema(
        "digest string, first struct<arrival:long,doc_id:long,locator:string>, rows long, "
        "best struct<n_points:long,back:long>, batch long"
    ).parquet(seen)
    # Every change of a digest was written; the newest holds its whole count.
    return changes.groupBy("digest").agg(F.max(F.struct("batch", "first", "rows", "best")).alias("last")).select(
        "digest", F.col("last.first.doc_id").alias("rep_id"), F.col("last.first.locator").alias("locator"),
        F.col("last.rows").alias("rows"), _kept(F.col("last.best")).alias("keep_id"),
    )


def _differing(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows (doc_id, digest) whose full text is not that of their digest's first row."""
    hit = cut(reps.where(F.col("rows") > 1).select(F.col("digest").alias("_digest"), "rep_id", F.col("locator").alias("_locator")))
    # Only texts that another row may equal are compared. Texts and digests meet by a shuffle at
    # every size: how many digests repeat grows with the documents.
    held = cut(texts.join(hit.hint("merge"), texts.digest == hit["_digest"], "left_semi"))
    # A first row that is repeated gives one text, not one per repeat.
    place = held.doc_id.eqNullSafe(hit.rep_id) & (held.locator == hit["_locator"])
    first = cut(
        held.join(hit, place & (held.digest == hit["_digest"]))
        .select("_digest", F.col("norm").alias("_first")).distinct()
    )
    # Written before it is made distinct: on its own, Spark can split the join of a hot digest.
    found = cut(
        held.join(first, held.digest == first["_digest"]).where(F.col("norm") != F.col("_first")).select("doc_id", "digest")
    )
    return found.distinct()


def _rounds(docs: DataFrame, digest: Digest, files_per_batch: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n_points, class) and the classes (class, keep_id, group_size): equal texts, and only they, share a class."""
    spark, turn = docs.sparkSession, 0
    rows_of, kept_of = [], []
    pending = narrow(docs).select(
        "doc_id", normalised().alias("norm"), F.char_length(content()).cast("long").alias("n_points"),
        F.input_file_name().alias("locator"),
    )
    while True:
        folder = working_folder(spark, "exact-dedup")
        texts = pending.withColumn("digest", digest(F.col("norm"), turn))
        texts.drop("norm").withColumn("arrival", F.lit(0).cast("long")).write.parquet(f"{folder}/landed")
        landed = spark.read.parquet(f"{folder}/landed")
        reps = cut(keyed_state(landed, folder, files_per_batch))
        differing = _differing(texts.select("doc_id", "digest", "norm", "locator"), reps)
        name = F.concat(F.lit(f"{turn}:"), "digest").alias("class")
        state = reps.select("digest", "keep_id", F.col("rows").alias("group_size"))
        if differing.isEmpty():
            rows_of.append(landed.select("doc_id", "n_points", name))
            kept_of.append(state.select(name, "keep_id", "group_size"))
            break
        on = lambda x: x.doc_id.eqNullSafe(differing.doc_id) & (x.digest == differing.digest)
        remain = cut(landed.join(differing, on(landed), "left_anti").select("doc_id", "n_points", "digest"))
        parted = cut(differing.select("digest").distinct())
        counted = (
            remain.join(parted, "digest", "left_semi").groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))
            .select("digest", _kept(F.col("best")).alias("keep_id"), "group_size")
        )
        rows_of.append(remain.select("doc_id", "n_points", name))
        kept_of.append(state.join(parted, "digest", "left_anti").unionByName(counted).select(name, "keep_id", "group_size"))
        pending = cut(texts.join(differing, on(texts), "left_semi").drop("digest"))
        turn += 1
    return reduce(DataFrame.unionByName, rows_of), reduce(DataFrame.unionByName, kept_of)


def deduplicate(docs: DataFrame, digest: Digest = sha256_digest, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, class.

    Of equal texts the one with the most code points stays, then the smallest doc_id.
    """
    rows, kept = _rounds(docs, digest, files_per_batch)
    return rows.join(kept, "class").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "class"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row each, with all their columns.

    What goes is fewer than what stays, so texts meet the doc_ids that go. Rows that share a
    doc_id, or have none, are told apart by their digest; of repeated rows the longest stays,
    then the first by text.
    """
    rows = cut(deduplicate(docs).select("doc_id", "kept", _digest_of("class").alias("digest")))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("kept").alias("kept"))
    shared = F.col("doc_id").isNull() | (F.col("rows") > 1)
    marked = cut(ids.where(shared | ~F.col("kept")).select("doc_id", shared.alias("shared")))
    once = without(docs, marked.select("doc_id"))
    shared_ids = marked.where("shared").select("doc_id")
    if shared_ids.isEmpty():
        return once
    held = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    held = held.join(shared_ids, held.doc_id.eqNullSafe(shared_ids.doc_id), "left_semi")
    held = held.withColumn("digest", sha256_digest(normalised(), 0))
    keep = rows.where("kept")
    held = held.join(keep, held.doc_id.eqNullSafe(keep.doc_id) & (held.digest == keep.digest), "left_semi")
    order = Window.partitionBy("doc_id", "digest").orderBy(F.char_length(content()).desc(), "text")
    first = held.withColumn("number", F.row_number().over(order)).where("number = 1")
    return once.unionByName(first.select("row.*"))


def _digest_of(name: str) -> Column:
    return F.substring_index(name, ":", -1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select(
        "doc_id", "keep_id", "group_size", "kept", _digest_of("class").alias("text_sha256")
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
