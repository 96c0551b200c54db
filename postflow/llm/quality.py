"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target text (labelled as of good
quality) and one of raw text (every document), give each document the log of its importance
weight: the sum over its n-grams of the log ratio of their probabilities. Documents are then
drawn without replacement in proportion to their weights by the Gumbel top-k trick: a fixed
noise per document is added to its log weight and the k largest stay.

The raw model counts all documents; the target model counts a labelled sample of a bounded
size (`TARGET_SAMPLE`). How many documents are drawn is part of the operator; by default it
is the share of good ones among the labels.

A long document adds up many small differences between the models, so a sum over `SPAN`
n-grams weighs as much as a longer one: the log weight is the mean log ratio times the
number of n-grams, but at most `SPAN`.

Defined results: a null or blank text has no n-grams and log weight 0. Documents whose keys
are equal are ranked by doc_id, nulls first. A repeated row is a document of its own. Without
labels of good quality the models coincide and the draw is uniform. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import positions
from ..session import cut
from .common import held_out, narrow, small, table, texts_of

BUCKETS = 1 << 14
TARGET_SAMPLE = 20_000
SPAN = 200
SEED = 20
MEMORY = 500_000  # words that a worker remembers; beyond it the memory starts anew


class WordHashes(dict):
    """Word to its 64-bit hash, found on first use."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def buckets(text: str, hashes: WordHashes) -> np.ndarray:
    """The buckets of the words and word pairs of a text, lower-cased."""
    if len(hashes) > MEMORY:
        hashes.clear()
    words = text.lower().split()
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    return (np.concatenate([one, two]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50)).astype(np.int64)


def count_buckets(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                total += np.bincount(buckets(text, hashes), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # one row per bucket
    total = np.zeros(BUCKETS, np.int64)
    total[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return total


def targets(docs: DataFrame, labels: DataFrame, most: int = TARGET_SAMPLE) -> tuple[DataFrame, float]:
    """Texts labelled as good (about `most` of them, by a hash of the doc_id) and their share among the labels."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = (F.col("quality") > 0).cast("int")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(good).alias("good"))
    size = known.agg(F.count(F.lit(1)).alias("rows"), F.sum("good").alias("good")).first()
    rows, number = size["rows"], size["good"] or 0
    draw = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    chosen = F.broadcast(known.where((F.col("good") == 1) & (draw < min(1.0, most / max(1, number)))).select("_id"))
    docs = narrow(docs)
    return docs.join(chosen, docs.doc_id == chosen["_id"], "left_semi"), number / rows if rows else 1.0


def train(docs: DataFrame, labels: DataFrame, most: int = TARGET_SAMPLE) -> tuple[np.ndarray, float]:
    """The log ratio of target to raw probability per bucket, and the share of good labels."""
    good, share = targets(docs, labels, most)
    raw, target = count_buckets(docs) + 1.0, count_buckets(good)
    if not target.any():
        return np.zeros(BUCKETS), share
    # The target model falls back on the raw one where the sample is silent.
    target = target + raw / raw.sum() * BUCKETS
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), share


def weigh(docs: DataFrame, ratio: Broadcast, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, mean_log_ratio, log_weight, gumbel_key."""
    names = ["doc_id", "n_grams", "mean_log_ratio"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            found = [buckets(t, hashes) for t in texts_of(batch)]
            means = [float(ratio.value[f].mean()) if len(f) else 0.0 for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array(means, pa.float64())],
                names=names,
            )

    rows = narrow(docs).mapInArrow(work, "doc_id long, n_grams long, mean_log_ratio double")
    even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    weight = F.col("mean_log_ratio") * F.least("n_grams", F.lit(SPAN))
    return rows.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(even)))


def resample(docs: DataFrame, ratio: Broadcast, share: float, seed: int = SEED) -> DataFrame:
    """One row per document with its rank by key; `sampled` marks the round(share * documents) first."""
    rows = cut(weigh(docs, ratio, seed))
    most = round(share * rows.count())
    order = [F.desc("gumbel_key"), F.asc_nulls_first("doc_id")]
    ranked = positions(rows.withColumn("_all", F.lit(0)), "_all", order, "rank").drop("_all")
    return ranked.withColumn("sampled", F.col("rank") <= most)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratio, share = train(docs, table(spark, sf_dir, "labels"))
    return resample(docs, spark.sparkContext.broadcast(ratio), share)
