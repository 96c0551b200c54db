"""Stretches of words that repeat themselves: found by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(`LEAST`, `TIMES` * q) that no neighbouring word extends. Each of its words occurs at
least `TIMES` times in it, so a word that occurs less often within a segment lies in no run
of that segment and splits it. The parts are counted again until nothing splits; nearly all
of an ordinary text falls away here.

A segment that survives is scanned lag by lag. Short lags compare every word with the one a
lag later. Longer lags look at every q-th word only: a run of period q spans at least
`TIMES` - 1 of these places in a row at which the word is that of the next place; from such
places the whole stretch is read. This takes m log m comparisons for m words, not m times m.
Places inside a run whose period divides q repeat at lag q as well and are passed over.
(Two runs overlap by less than the sum of their periods, so nothing else is passed over.)

Splitting stops after `DEPTH` rounds at the latest; what is left is scanned as it is, so this
bounds the work on contrived texts and changes no result.

Defined results: a null text is an empty text; it has no runs and collapses to an empty
text. A null doc_id stays null. Repeated rows each give a row. An empty table gives no rows.
Words are parted by ASCII blanks and compared byte by byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import narrow, small, texts_of

LEAST = 6
TIMES = 4
DEPTH = 64
SHORT = 8  # lags below it compare all words
_STEP = 256

Arrange = Callable[[int | None, list[bytes]], list[bytes]]


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal stretches of true flags that are long enough, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    held = ends - starts >= least
    return list(zip(starts[held].tolist(), ends[held].tolist()))


def segments(words: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie, after splitting at rare words to stability. Words are small numbers."""
    settled, open_ = [], [(0, len(words))] if len(words) >= LEAST else []
    for _ in range(DEPTH):
        if not open_:
            break
        parts = []
        for start, end in open_:
            part = words[start:end]
            # Numbers of a short part may be large, so they are made small again.
            small_ones = part if end - start == len(words) else np.unique(part, return_inverse=True)[1]
            frequent = np.bincount(small_ones)[small_ones] >= TIMES
            if frequent.all():
                settled.append((start, end))
            else:
                parts += [(start + a, start + b) for a, b in _stretches(frequent, LEAST)]
        open_ = parts
    return sorted(settled + open_)


def _repeats_until(words: np.ndarray, lag: int, at: int) -> int:
    """The first place from `at` on whose word is not that a lag later."""
    step, limit = _STEP, len(words) - lag
    while at < limit:
        end = min(limit, at + step)
        differ = words[at:end] != words[at + lag : end + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 2 * step
    return limit


def _repeats_from(words: np.ndarray, lag: int, at: int) -> int:
    """The first place of the stretch of repeats that holds `at`."""
    step = _STEP
    while at > 0:
        start = max(0, at - step)
        differ = words[start:at] != words[start + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = start, 2 * step
    return 0


def scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a segment as (start, end, period), lag by lag."""
    found: list[tuple[int, int, int]] = []
    extents: set[tuple[int, int]] = set()
    lasting: list[tuple[int, int, int]] = []

    def add(start: int, end: int, lag: int) -> None:
        if (start, end) not in extents:  # else it is a run of a smaller period
            extents.add((start, end))
            found.append((start, end, lag))
            lasting.append((start, end, lag))

    for lag in range(1, len(words) // TIMES + 1):
        least = max(LEAST, TIMES * lag) - lag
        if lag < SHORT:
            for start, end in _stretches(words[:-lag] == words[lag:], least):
                add(start, end + lag, lag)
            continue
        lasting = [r for r in lasting if r[1] - r[0] >= TIMES * lag]
        places = words[::lag]
        same = places[:-1] == places[1:]
        for start, end, period in lasting:
            if lag % period == 0:
                same[-(-start // lag) : (end - 1 - lag) // lag + 1] = False
        row = same[: 2 - TIMES].copy()
        for k in range(1, TIMES - 1):
            row &= same[k : len(same) + k + 2 - TIMES]
        done = -1
        for at in (np.flatnonzero(row) * lag).tolist():
            if at <= done:
                continue
            start, done = _repeats_from(words, lag, at), _repeats_until(words, lag, at)
            if done - start >= least:
                add(start, done + lag, lag)
    return found


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs of a text as (start, length, period), by start, then period."""
    numbers: dict[bytes, int] = {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    found = [
        (first + start, end - start, period)
        for first, last in segments(coded) for start, end, period in scan(coded[first:last])
    ]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, less those that a run contains after its first period, joined by blanks."""
    if not found:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def collapse(docs: DataFrame, arrange: Arrange | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed text. `arrange` may change the words first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in small(batches):
            all_runs, texts = [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                words = text.encode().split()  # bytes: ASCII blanks only
                if arrange is not None:
                    words = arrange(key, words)
                found = runs(words)
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(all_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    return narrow(docs).mapInArrow(
        work, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted(key: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten repeats a stretch of itself to its end; which one and how follows its doc_id."""
    if key is None or not words:
        return words
    mark = zlib.crc32(str(key).encode())
    if mark % 10:
        return words
    g, n = mark // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def digests(found: DataFrame) -> DataFrame:
    """The longest run and digests of all runs and of the collapsed text."""
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    length, start, period = F.col("best.n"), -F.col("best.s"), -F.col("best.p")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted))
