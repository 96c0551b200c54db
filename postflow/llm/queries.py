"""The registered queries of the text operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, exact_dedup, language_id, packing, periodic_runs, pii, quality, simhash, subwords, token_counts,
    token_store, toxicity, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

# A batch for the Python workers holds whole texts, so it is kept to few rows.
BATCH_ROWS = 1024


def settings(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _with_settings(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        settings(spark)
        return query(spark, sf_dir)

    return run


_ALL: list[Query] = [
    decontaminate.op1_decontaminate, subwords.op2_sentencepiece, pii.op3_pii, toxicity.op4_toxicity,
    simhash.op5_simhash, token_store.op6_token_store, quality.op7_quality, exact_dedup.op8_exact_dedup,
    token_counts.op9_token_counts, language_id.op10_language_id, whitening.op11_whitening,
    packing.op12_packing, periodic_runs.op13_periodic_runs,
]

QUERIES: dict[str, Query] = {q.__name__: _with_settings(q) for q in _ALL}
ORACLES: dict[str, str] = {"op8_exact_dedup": exact_dedup.ORACLE}
