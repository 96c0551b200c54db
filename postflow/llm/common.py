"""What the text operators share: table access, batches for Arrow workers, union of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The whitespace class [\x20\x09-\x0D], as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so no other column can clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among `ids`, a written table, with all their columns.

    Spark sends the ids to the texts while they are few and small, and shuffles both otherwise.
    """
    gone = ids.select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]), "left_anti")


def content(text: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Shorter batches: what a worker holds beside the texts follows their number."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def roots(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest node that each node reaches over the links (left, right)."""
    label = np.arange(nodes)
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if np.array_equal(label, before):
            return label
