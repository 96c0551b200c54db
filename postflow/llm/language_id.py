"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a blank, and the n-grams of each length are
hashed by numpy over whole batches. Counts per language come from a labelled sample of a
bounded size per language; the log-probabilities form one matrix of buckets by languages,
whose size follows from its shape, and a text's score is the sum of the rows of its n-grams.

Defined results: a null text, and one without a letter, is `und` with score 0, as is every
text when nothing could be learned. A null doc_id or a repeated row gets a row like any
other. Texts are read whole, in stretches of a fixed length that share their n-grams. Equal
scores fall to the first language by name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held_out, small

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3)
STRETCH = 1 << 18  # characters that are hashed at once
MAX_LANGUAGES = 1000  # the matrix then has 250 MB; language codes are a closed list
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd multipliers, any would do


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point to itself for letters, to a blank for the rest."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of every n-gram of this order."""
    last = len(codes) - order + 1
    mixed = codes[:last] * np.uint32(_FACTORS[0])
    for k in range(1, order):
        mixed = (mixed ^ (mixed >> np.uint32(15))) + codes[k : last + k] * np.uint32(_FACTORS[k])
    mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (mixed >> np.uint32(16)).astype(np.int64)


def stretches(text: str) -> Iterator[np.ndarray]:
    """The buckets of a whole text. Neighbouring stretches overlap, so no n-gram is lost or counted twice."""
    codes = _folded()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)]
    for start in range(0, len(codes), STRETCH):
        found = [_grams(codes[start : start + STRETCH + order - 1], order) for order in ORDERS if len(codes) - start >= order]
        if found:
            yield np.concatenate(found)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Labelled rows to learn from: about `per_language` of each language, chosen by a hash of the doc_id."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: `lang` does not hold language codes")
    share = {r["lang"]: per_language / r["rows"] for r in sizes if r["rows"] > per_language}
    if not share:
        return known
    rate = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    return known.where(F.coalesce(draw < rate, F.lit(True)))


def train(docs: DataFrame, per_language: int = 5000) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, buckets by languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for buckets in stretches(text):
                    total += np.bincount(buckets, minlength=BUCKETS)
        for lang, total in held.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(total[used])],
                names=["lang", "bucket", "n"],
            )

    counted = sample(docs, per_language).mapInArrow(count, "lang string, bucket long, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # buckets x languages at most
    languages = sorted(set(found.column("lang").to_pylist()))
    at = {lang: k for k, lang in enumerate(languages)}
    counts = np.ones((BUCKETS, len(languages)))
    column = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts[bucket, column] += n
    return languages, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], matrix: Broadcast) -> DataFrame:
    """doc_id, lang_pred, score: the most probable language and its posterior probability."""

    def guess(text: str | None) -> tuple[str, float]:
        if not text or not languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = np.zeros(len(languages))
        for buckets in stretches(text):
            total += matrix.value[buckets].sum(axis=0, dtype=np.float64)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return languages[best], float(odds[best] / odds.sum())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [guess(t) for t in batch.column("text").to_pylist()]
            names, scores = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, matrix = train(docs)
    found = predict(docs, languages, spark.sparkContext.broadcast(matrix))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
