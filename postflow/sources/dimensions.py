"""Small input tables: the watchlist and the labelled set, checked as they load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.quality import check_unique, check_vocabulary
from ..schemas import TIERS, WORK_MODES
from .readers import BOARD_SOURCES

WATCHLIST = "slug STRING, name STRING, ats STRING, token STRING, tier STRING, active BOOLEAN"
LABELLED = (
    "id STRING, company STRING, title STRING, location STRING, work_mode STRING, "
    "relevant BOOLEAN, note STRING, description STRING"
)


class InvalidInput(ValueError):
    """A table that must not be used; `problems` has every offending row by what is wrong with it."""

    def __init__(self, problems: dict[str, DataFrame], rows: dict[str, int]):
        super().__init__("; ".join(f"{what}: {n} rows, first {problems[what].first()}" for what, n in sorted(rows.items())))
        self.problems = problems


def _refuse(problems: dict[str, DataFrame]) -> None:
    rows = {what: n for what, df in problems.items() if (n := df.count())}
    if rows:
        raise InvalidInput({what: problems[what] for what in rows}, rows)


def load_watchlist(rows: DataFrame) -> DataFrame:
    """Watched companies: unique slugs, a known board type with its token, default tier and flag."""
    entries = rows.select(
        "slug", "name", F.col("ats").alias("ats_type"),
        F.create_map(F.lit("token"), F.col("token")).alias("ats_config"),
        F.coalesce("tier", F.lit("discovered")).alias("tier"),
        F.coalesce("active", F.lit(True)).alias("active"),
    )
    blank = F.coalesce(F.trim("slug"), F.lit("")) == ""
    unnamed = F.coalesce(F.trim("name"), F.lit("")) == ""
    tokenless = F.coalesce(F.trim(F.col("ats_config")["token"]), F.lit("")) == ""
    _refuse({
        "duplicate slug": check_unique(entries, ["slug"]),
        "unknown board type": check_vocabulary(entries, "ats_type", list(BOARD_SOURCES)),
        "unknown tier": check_vocabulary(entries, "tier", TIERS),
        "missing slug, name, board type or token": entries.where(
            blank | unnamed | tokenless | F.col("ats_type").isNull()).select("slug"),
    })
    return entries


def load_labelled(rows: DataFrame) -> DataFrame:
    """Labelled postings: unique ids, required fields, an optional work mode."""
    required = ["id", "company", "title", "description"]
    blank = F.col("relevant").isNull()
    for c in required:
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    _refuse({
        "duplicate id": check_unique(rows, ["id"]),
        "unknown work mode": check_vocabulary(rows, "work_mode", WORK_MODES),
        "missing field": rows.where(blank).select("id"),
    })
    return rows
