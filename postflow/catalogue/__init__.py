"""The registered queries: every operator over the given tables, with its SQL counterpart.

The tables stand in for the product's own: documents for postings, pages for HTML
payloads, labels for the labelled set, events for the action log, part for titles, orders
for snapshots, lineitem for scores, customer, nation and region for companies and places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import companies, postings, scoring, texts, tracking

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (texts, postings, scoring, tracking, companies)


def _with_settings(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {name: _with_settings(q) for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
