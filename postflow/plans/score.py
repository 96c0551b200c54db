"""One scoring run: from open postings to scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.inference import (
    BatchFunction, append_scores, capped_groups, require_answers, score_texts, scoring_report,
)
from ..operators.prefilter import POSTING_KEY, disposition, disposition_counts
from ..operators.reconcile import with_payloads
from ..session import cut
from ..sources.readers import BOARD_SOURCES, replay
from ..sources.store import State


@dataclass(frozen=True)
class ScoringRun:
    """The state after the run, its verdicts and its funnel."""

    state: State
    decided: DataFrame
    verdicts: DataFrame | None
    report: DataFrame


def stored_texts(postings: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records of stored postings of boards, from their payloads."""
    return replay(with_payloads(postings, payloads).select("source", F.col("source_job_id").alias("stored_id"), "raw"), BOARD_SOURCES).drop(
        "source_job_id").withColumnRenamed("stored_id", "source_job_id")


def prefilter_run(state: State, profile) -> DataFrame:
    """Every open posting with its disposition."""
    return disposition(state.postings, _texts_of(state), state.jobs, state.companies, state.scores, profile)


def _texts_of(state: State) -> Callable[[DataFrame], DataFrame]:
    """Replays the payloads of some postings: keys decide first, then payloads are read."""
    return lambda keys: stored_texts(state.postings.join(keys, POSTING_KEY, "left_semi"), state.all_payloads())


def run_scoring(
    state: State, profile, scorer: BatchFunction | None, model: str, now: Column,
    cap: int | None = None, max_failed_share: float = 1.0, store: str | None = None,
) -> ScoringRun:
    """Prefilter, then one call per distinct text up to the cap. No scorer: a dry run.

    With a `store` a run that dies keeps the answers it has, and the next one does not ask for them.
    """
    limit = cap if cap is not None else profile.max_scores_per_run
    decided = cut(prefilter_run(state, profile))
    counts = disposition_counts(decided, limit)
    if scorer is None:
        return ScoringRun(state, decided, None, counts)
    candidates = decided.where("disposition = 'candidate'")
    leads = capped_groups(candidates, limit).select("lead.source", "lead.source_job_id")
    texts = _texts_of(state)(leads)
    scores, verdicts = score_texts(candidates, texts, scorer, profile, model, now, limit, store)
    require_answers(verdicts, max_failed_share)
    after = state.with_(scores=append_scores(state.scores, scores))
    return ScoringRun(after, decided, verdicts, scoring_report(counts, verdicts, scores, limit))
