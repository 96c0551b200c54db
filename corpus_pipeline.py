"""From raw documents to clean, tokenised ones: the stages, run one after the other.

Each stage takes what the one before it kept, as a table it has written, and returns all
columns of `documents`; the last one returns the encoded documents instead. A stage drops
rows for its own reason only: null and empty texts, null doc_ids and extra columns pass
through as each operator defines, and a repeated row goes as a copy in `exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postflow.llm import decontaminate, exact_dedup, near_dedup, subwords, toxicity
from postflow.llm.queries import settings
from postflow.session import working_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold stay."""
    return toxicity.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by sets of five-word shingles with a similarity of 0.8 or more, one stays: SimHash first, the rest exactly."""
    return near_dedup.kept_documents(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontaminate.kept_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as ids, decoded again to prove them."""
    model = subwords.load_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return subwords.encode_documents(docs, model, remember=False)


def _with_settings(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settings(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _with_settings(non_toxic)),
    ("exact_dedup", _with_settings(exact)),
    ("near_dedup", _with_settings(near)),
    ("decontamination", _with_settings(uncontaminated)),
    ("sentencepiece", _with_settings(encoded)),
]

# Classes of similar texts, trained scores, alignments and subword paths are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = working_folder(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
