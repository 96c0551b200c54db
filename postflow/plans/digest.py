"""The daily digest and the dashboard: what the stored tables say today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import local_day
from ..operators import ranking as K, tracking as T
from ..operators.places import location_match
from ..operators.prefilter import POSTING_KEY
from ..session import cut
from ..sources.store import State

# How long a company is news, and how long the first batch of companies took.
NEW_COMPANY_DAYS = 7
SEED_BATCH_SECONDS = 60


def new_companies(companies: DataFrame, postings: DataFrame, now: Column, zone: str) -> DataFrame:
    """Companies added in the last week with their position, newest first, and their open postings."""
    return _placed(_added_lately(companies, postings, now, zone), [F.desc("created_at"), F.desc("slug")], None)


def _added_lately(companies: DataFrame, postings: DataFrame, now: Column, zone: str) -> DataFrame:
    """Companies added in the last week.

    Those created within a minute of the very first one are the seed list, not news.
    """
    moment = now.cast("timestamp")
    first = companies.agg(F.min("created_at").alias("_first"), F.lit(1).alias("_one"))
    open_counts = postings.where("is_open AND company_slug IS NOT NULL").groupBy(
        F.col("company_slug").alias("slug")).agg(F.count(F.lit(1)).alias("open_postings"))
    recent = companies.where(F.col("created_at") >= moment - F.expr(f"INTERVAL {NEW_COMPANY_DAYS} DAYS"))
    return (
        # `first` is a single row by construction, so the many rows stay where they are.
        recent.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one")
        .where(F.col("created_at") > F.col("_first") + F.expr(f"INTERVAL {SEED_BATCH_SECONDS} SECONDS"))
        .join(open_counts, "slug", "left")
        .select("slug", "name", "tier", "ats_type", F.coalesce("open_postings", F.lit(0)).alias("open_postings"),
                local_day(F.col("created_at"), zone).alias("added"), "created_at")
    )


def shortlist(state: State, profile) -> DataFrame:
    """Jobs at or above the threshold that nobody acted on, with company, best score and fit."""
    best = K.best_scores(state.scores, state.postings, profile.prompt_version).where(
        F.col("score") >= profile.threshold)
    acted = state.applications.where("status <> 'interested'").select("job_key")
    won = best.select("job_key", "score", "summary", "concerns", "work_authorization", F.col("url").alias("_won_url"))
    named = state.companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"))
    fit = location_match(F.col("region"), F.col("regions"), F.col("work_mode"), profile.priority, profile.acceptable)
    return (
        state.jobs.join(won, "job_key").join(acted, "job_key", "left_anti").join(named, "company_slug")
        .withColumn("apply_url", F.coalesce(F.nullif("_won_url", F.lit("")), F.col("apply_url"))).drop("_won_url")
        .withColumn("location_match", fit)
    )


def _listed(state: State, profile) -> DataFrame:
    """The shortlist with the section of each job, without jobs that belong to none."""
    section = K.section_for(F.col("location_match.fit"), F.col("work_authorization"))
    return shortlist(state, profile).withColumn("section", section).where("section IS NOT NULL")


def _shown(listed: DataFrame, state: State, rules, today: Column) -> DataFrame:
    """Keys and order columns of the listed jobs with their repeat state; no display column goes along."""
    ranked_by = listed.select("section", "job_key", "score", "content_hash", "company", "title")
    return K.repeat_state(ranked_by, state.digest_appearances, rules, before=today)


def digest_entries(state: State, profile, rules, today: Column) -> DataFrame:
    """The sections' entries with positions.

    The shortlist is written once, unsorted. Only keys and order columns are sorted, and what
    an entry shows is joined to its rank.
    """
    fit, place = F.col("location_match.fit"), F.col("location_match.place")
    listed = cut(_listed(state, profile).select(
        "section", "job_key", "company", "title",
        F.coalesce(F.nullif("location_raw", F.lit("")), F.lit("not stated")).alias("location"),
        "work_mode", "region", "score", F.trim(F.coalesce("summary", F.lit(""))).alias("summary"),
        "concerns", "work_authorization", "apply_url", "content_hash",
        fit.alias("fit"), place.alias("matched_place"),
        K.section_note(fit, F.col("work_authorization"), place, F.col("region")).alias("section_note"),
    ))
    ranked = K.positions(_shown(listed, state, rules, today).where("NOT suppressed").drop("suppressed", "content_hash"),
                         "section", K.entry_order())
    return listed.join(ranked.select("job_key", "appearance", "demoted", "position"), "job_key").withColumn(
        "repeat_note", K.repeat_note(F.col("appearance"), F.col("demoted")))


def digest_counts(state: State, profile, rules, today: Column, now: Column, zone: str) -> DataFrame:
    """One row about the day, counted without ranking anything."""
    shown = F.col("suppressed") == F.lit(False)
    summary = _shown(_listed(state, profile), state, rules, today).agg(
        F.count_if(shown).alias("total"), *[F.count_if(shown & (F.col("section") == s)).alias(s) for s in K.SECTIONS],
        F.count_if("suppressed").alias("still_open"))
    waiting = state.candidate_companies.agg(F.count_if(F.col("status") == "pending").alias("pending_candidates"))
    news = _added_lately(state.companies, state.postings, now, zone).agg(F.count(F.lit(1)).alias("new_companies"))
    # Three frames of one row each.
    for part in (waiting, news):
        summary = summary.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return summary.withColumn("digest_date", today.cast("date")).withColumn("is_empty", F.col("total") == 0)


def daily_digest(state: State, profile, rules, today: Column, now: Column, zone: str) -> tuple[DataFrame, DataFrame]:
    """(entries, summary): the sections' entries with positions, and one row about the day.

    An empty digest is a valid result. `rules` is the repeat suppression.
    """
    return digest_entries(state, profile, rules, today), digest_counts(state, profile, rules, today, now, zone)


def open_roles(state: State, profile, rules, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the open roles with their position, best first, how many there are): everything not
    acted on, suppressed or not. A limit is the caller's.

    Unlike the digest the history includes today, and the flag says what the next digest
    would do.
    """
    listed = shortlist(state, profile)
    shown = K.repeat_state(listed, state.digest_appearances, rules)
    roles = shown.select(
        "job_key", "title", "company",
        F.coalesce(F.nullif("location_raw", F.lit("")), F.lit("not stated")).alias("location"), "work_mode", "score",
        "apply_url", (F.col("appearance") - 1).alias("appearances"), "suppressed",
    )
    best_first = [F.desc("score"), F.lower("company"), F.lower("title"), F.col("job_key")]
    return _placed(roles, best_first, limit), listed.agg(F.count(F.lit(1)).alias("open_total"))


def _placed(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Rows with their position in `order`, all of them or the first `limit`."""
    placed = K.positions(rows.withColumn("_all", F.lit(0)), "_all", order).drop("_all")
    return placed if limit is None else placed.where(F.col("position") <= limit)


def dismissed_roles(state: State, profile, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the dismissals with their position, latest first, how many there are), with each job's score as it is now."""
    gone = state.applications.where("status = 'dismissed'")
    newest = _placed(gone, [F.desc("created_at"), F.desc("job_key")], limit)
    best = K.best_scores(state.scores, state.postings, profile.prompt_version).select("job_key", "score")
    named = state.companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"))
    rows = newest.join(state.jobs.drop("first_seen"), "job_key").join(named, "company_slug").join(best, "job_key", "left")
    return (
        rows.select("job_key", "title", "company", F.coalesce(F.nullif("location_raw", F.lit("")), F.col("region")).alias("location"),
                    "work_mode", "score", F.col("created_at").alias("dismissed_at"), "apply_url", "position"),
        gone.agg(F.count(F.lit(1)).alias("dismissed_total")),
    )


def dashboard(state: State, profile, rules, open_limit: int | None = None, dismissed_limit: int | None = None) -> dict[str, DataFrame]:
    """Every frame of the dashboard by name."""
    facts = T.application_facts(state.applications, state.application_events)
    tiers = state.companies.select(F.col("slug").alias("company_slug"), "tier")
    sliced = (
        facts.join(state.jobs.select("job_key", "company_slug"), "job_key").join(tiers, "company_slug")
        .join(T.primary_sources(state.jobs, state.postings), "job_key")
    )
    roles, roles_total = open_roles(state, profile, rules, open_limit)
    gone, gone_total = dismissed_roles(state, profile, dismissed_limit)
    return {
        "pipeline": T.pipeline(state.applications),
        "funnel": T.funnel(facts),
        "endings": T.funnel(facts, T.FUNNEL_ENDINGS),
        "response_rates": T.response_rates(sliced, ["source", "tier"]),
        "applications": T.tracked_applications(facts, state.application_events, state.jobs, state.companies, state.postings),
        "timeline": T.timeline(state.application_events),
        "open_roles": roles,
        "open_total": roles_total,
        "dismissed_roles": gone,
        "dismissed_total": gone_total,
        "best_scores": K.best_scores(state.scores, state.postings, profile.prompt_version).select("job_key", *POSTING_KEY, "score"),
    }
