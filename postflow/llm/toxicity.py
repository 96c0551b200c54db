"""Toxicity by multiple-instance learning: documents carry labels, sentences carry scores.

A sentence's probability is logistic in its words and their beginnings; a document is toxic unless none
of its sentences is and no unseen cause (the leak) makes it so: noisy-or. Weights, bias and
leak are learned from document labels alone, and the sentences that raise a document's score
are located afterwards. Only features that documents labelled toxic hold far more often
can witness toxicity, so weights are not negative and few.

Learning takes a labelled sample of a bounded size per class (`SAMPLE`); class sizes weigh
it back to the labels' own mix, so scores stay probabilities.

Defined results: a null text is an empty text; a text without sentences scores the leak
alone. A null doc_id or a repeated row gets a row like any other, and a doc_id with several
labels is toxic if one of them says so. Without labels of both kinds every score is 0. Texts
of any length are read whole. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .common import held_out, narrow, small, table, texts_of

SAMPLE = 5000  # labelled documents per class that are learned from, in expectation
MAX_FEATURES = 4096  # features of the model
BEGINNINGS = range(3, 9)
MIN_DOCUMENTS = 5  # toxic documents of the sample that hold a feature of the model
MIN_SIGMA = 5.0  # standard errors between a feature's share in toxic and in clean documents
THRESHOLD = 0.3
MEMORY = 300_000  # runs that a worker remembers; beyond it the memory starts anew
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every stretch between sentence ends that is not blank."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def keys_of(word: str) -> list[int]:
    """A word's features: itself and its beginnings, so that inflected and compound forms share one."""
    forms = [word, *(f"{word[:k]}~" for k in BEGINNINGS if k < len(word))]
    return [xxhash.xxh64_intdigest(f) >> 1 for f in forms]


def features(text: str) -> set[int]:
    return {key for word in set(_WORD.findall(text.lower())) for key in keys_of(word)}


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0
    leak: float = 0.0

    def doubt(self, logit: float) -> float:
        """-log of the probability that a sentence of this logit is clean."""
        return float(np.logaddexp(0.0, logit))


class Scorer:
    """A model together with the runs of non-blanks a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self.plain = model.doubt(model.bias)
        self.words: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, bool] = {}

    def _weighted(self, text: str) -> set[int]:
        """The features of a lower-case text that have a weight."""
        found: set[int] = set()
        for word in _WORD.findall(text):
            keys = self.words.get(word)
            if keys is None:
                keys = self.words[word] = tuple(k for k in keys_of(word) if k in self.model.weights)
            found.update(keys)
        return found

    def _may_witness(self, text: str) -> bool:
        """Whether some word of the lower-case text has a weight."""
        runs, known = set(text.split()), self.runs
        if len(known) > MEMORY:
            known.clear()
            self.words.clear()
        for run in runs.difference(known):
            known[run] = bool(self._weighted(run))
        return any(map(known.__getitem__, runs))

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int]]]:
        """The document's score, its number of sentences, and the sentences that offend by themselves."""
        spans = sentences(text)
        doubt, offending = self.model.leak + self.plain * len(spans), []
        if self._may_witness(text.lower()):
            for start, end in spans:
                if keys := self._weighted(text[start:end].lower()):
                    own = self.model.doubt(self.model.bias + sum(self.model.weights[k] for k in keys))
                    doubt += own - self.plain
                    if -np.expm1(-own) >= THRESHOLD:
                        offending.append((start, end))
        return float(-np.expm1(-doubt)), len(spans), offending


def learn(
    label: np.ndarray, number: np.ndarray, telling: np.ndarray, lengths: np.ndarray, words: np.ndarray,
    size: int, weigh: tuple[float, float], steps: int = 400,
) -> tuple[np.ndarray, float, float]:
    """Weights of `size` features, bias and leak.

    Per document its label, its number of sentences and how many of them are telling; per
    telling sentence how many features it holds; and those features, one behind the other.
    Minimises the log-loss of noisy-or by Adam over the whole sample; weights stay at or above 0.
    """
    count = len(label)
    owner = np.repeat(np.arange(count), telling)
    at = np.repeat(np.arange(len(lengths)), lengths)
    quiet = (number - telling).astype(np.float64)
    worth = np.where(label == 1, weigh[1], weigh[0])
    worth /= worth.sum()
    theta = np.concatenate([np.full(size, 4.0), [-8.0, -4.0]])  # weights, bias, log leak
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for step in range(1, steps + 1):
        w, b, leak = theta[:-2], theta[-2], np.exp(theta[-1])
        z = b + np.bincount(at, w[words], minlength=len(lengths))
        doubt = np.bincount(owner, np.logaddexp(0, z), minlength=count) + quiet * np.logaddexp(0, b) + leak
        pull = worth * np.where(label == 1, -1 / np.expm1(np.clip(doubt, 1e-9, 500)), 1.0)
        each = pull[owner] * sigmoid(z)
        grad = np.concatenate([
            np.bincount(words, each[at], minlength=size) + 1e-5 * w,
            [each.sum() + (pull * quiet).sum() * sigmoid(b), pull.sum() * leak],
        ])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        theta -= 0.1 * (1 - step / (steps + 1)) * move
        theta[:-2] = np.maximum(theta[:-2], 0)
    return theta[:-2], float(theta[-2]), float(np.exp(theta[-1]))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """Labelled texts to learn from (a written table: toxic, text) and the share of each class it holds.

    The chosen labels are of a bounded number, so they go to the documents and no text is shuffled.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["rows"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows")).collect()}
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    keep = F.when(F.col("toxic") == 1, draw < share.get(1, 1.0)).otherwise(draw < share.get(0, 1.0))
    docs = narrow(docs)
    chosen = F.broadcast(known.where(keep))  # two classes of about `per_class` rows
    return cut(docs.join(chosen, docs.doc_id == chosen["_id"]).select("toxic", F.coalesce("text", F.lit("")).alias("text"))), share


def _telling(rows: DataFrame) -> list[int]:
    """Keys of the features that toxic documents of the sample hold far more often than clean ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch)):
                for key in features(text):
                    held.setdefault(key, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))],
            names=["feature", "clean", "toxic"],
        )

    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return []
    total = size[0] + size[1]
    both = F.col("clean") + F.col("toxic")
    error = F.sqrt(both / total * (1 - both / total) * (1 / size[0] + 1 / size[1]))
    found = rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    sigma = (F.col("toxic") / size[1] - F.col("clean") / size[0]) / error
    telling = found.where(F.col("toxic") >= MIN_DOCUMENTS).withColumn("sigma", sigma).where(F.col("sigma") >= MIN_SIGMA)
    return [r["feature"] for r in telling.orderBy(F.desc("sigma"), "feature").limit(MAX_FEATURES).collect()]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    rows, share = sample(docs, labels, per_class)
    keys = _telling(rows)
    if not keys:
        return Model()
    place = {key: k for k, key in enumerate(keys)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document its label, its number of sentences, and the telling features by sentence."""
        for batch in small(batches):
            out = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch)):
                spans = sentences(text)
                found = [sorted(place[k] for k in features(text[a:b]) & place.keys()) for a, b in spans]
                out.append((toxic, len(spans), [f for f in found if f]))
            columns = list(zip(*out)) if out else [(), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["toxic", "n", "words"])

    seen = rows.mapInArrow(look, "toxic int, n long, words array<array<int>>").toArrow()
    documents = seen.column("words").combine_chunks()
    told = documents.flatten()
    weights, bias, leak = learn(
        seen.column("toxic").to_numpy(), seen.column("n").to_numpy(), pc.list_value_length(documents).to_numpy(),
        pc.list_value_length(told).to_numpy(), told.flatten().to_numpy(), len(keys), (1 / share[0], 1 / share[1]),
    )
    return Model({key: float(w) for key, w in zip(keys, weights) if w > 0}, bias, leak)


def score_column(model: Broadcast) -> Column:
    """The score of `text`, as a column of any frame that has one."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for texts in parts:
            yield texts.fillna("").map(lambda t: scorer.score(t)[0]).astype(float)

    return score("text")


def score_documents(docs: DataFrame, model: Broadcast) -> DataFrame:
    """doc_id, score, n_sentences, offending (start and end of each sentence that offends by itself)."""
    names = ["doc_id", "score", "n_sentences", "offending"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in small(batches):
            rows = [scorer.score(t) for t in texts_of(batch)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            spans = [[{"start": a, "end": b} for a, b in found] for found in columns[2]]
            kinds = (pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            arrays = [pa.array(c, k) for c, k in zip((columns[0], columns[1], spans), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    schema = "doc_id long, score double, n_sentences long, offending array<struct<start: long, end: long>>"
    return narrow(docs).mapInArrow(work, schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.where(score_column(model) < THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_sentences", F.size("offending").alias("n_offending"),
    )
