"""Which open postings are worth a scorer's time, and why the rest are not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash, first_term, words_only
from ..session import cut
from .places import location_match

POSTING_KEY = ["source", "source_job_id"]


def title_exclusion(title: Column, profile) -> Column:
    """The excluded title word, else the excluded seniority prefix, found in a title."""
    words = words_only(title)
    return F.coalesce(
        first_term(words, profile.title_exclude),
        first_term(words, profile.seniority_exclude, prefix=True),
    )


def exclusion_reason(title: Column, fit: Column, profile) -> Column:
    """Why a job is out, title before location; null when it may go on."""
    term = title_exclusion(title, profile)
    return F.when(term.isNotNull(), F.concat(F.lit("title: "), term)).when(fit == "excluded", F.lit("location"))


def _whole_text(title: Column, description: Column) -> Column:
    return words_only(F.concat_ws("\n", title, description))


def matched_term(title: Column, description: Column, profile) -> Column:
    """The generous union: an included title, else any keyword anywhere in the text."""
    return F.coalesce(
        first_term(words_only(title), profile.title_include),
        first_term(_whole_text(title, description), [*profile.strong, *profile.supporting]),
    )


def strong_term(title: Column, description: Column, profile) -> Column:
    """An included title or a strong keyword anywhere, never a supporting one."""
    return first_term(_whole_text(title, description), [*profile.title_include, *profile.strong])


def open_attached(postings: DataFrame) -> DataFrame:
    """Open postings that belong to a job; sightings have none."""
    return postings.where(F.col("is_open") & F.col("job_key").isNotNull())


def unjudged(postings: DataFrame, scores: DataFrame, version: int) -> DataFrame:
    """Postings whose current text has no score of this version.

    A new version reopens every posting, a reworded text reopens one.
    """
    judged = scores.where(F.col("prompt_version") == version).select(*POSTING_KEY, "content_hash")
    return postings.join(judged, [*POSTING_KEY, "content_hash"], "left_anti")


def disposition(
    postings: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame], jobs: DataFrame, companies: DataFrame, scores: DataFrame, profile
) -> DataFrame:
    """Every open attached posting with what the prefilter decided about it, without its text.

    `texts` is the replayed record of stored postings (key, `title`, `location_raw`,
    `description`), or a function that replays the postings whose keys it is given. Adds `disposition` (already_judged, title, location, stale, unmatched or
    candidate), `matched_on`, `location_fit`, and the job's display columns.

    Cheap rules first: jobs are ruled out on the job table, and judged postings by key. Only
    what is left meets its text, so a run that finds little new reads little text and moves
    none of the rest.
    """
    fit = location_match(
        F.col("region"), F.col("regions"), F.col("work_mode"), profile.priority, profile.acceptable
    )
    ruled = (
        jobs.select("job_key", "company_slug", F.col("title").alias("job_title"), "region", "regions", "work_mode")
        .withColumn("location_fit", fit["fit"])
        .withColumn("reason", exclusion_reason(F.col("job_title"), F.col("location_fit"), profile))
        .join(companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company")), "company_slug")
    )
    judged = scores.where(F.col("prompt_version") == profile.prompt_version).select(
        *POSTING_KEY, "content_hash", F.lit(True).alias("judged")
    )
    open_rows = cut(
        open_attached(postings).select(*POSTING_KEY, "job_key", "content_hash", "first_seen")
        .join(judged, [*POSTING_KEY, "content_hash"], "left")
        .join(ruled, "job_key")
    )
    pending = open_rows.where("judged IS NULL AND reason IS NULL").select(*POSTING_KEY, "company", "content_hash")
    records = texts(pending.select(*POSTING_KEY)) if callable(texts) else texts
    read = records.select(*POSTING_KEY, "title", "location_raw", "description").join(pending, POSTING_KEY)
    current = content_hash(F.col("company"), F.col("title"), F.col("location_raw"), F.col("description"))
    compared = read.select(
        *POSTING_KEY,
        (current != F.col("content_hash")).alias("stale"),
        matched_term(F.col("title"), F.col("description"), profile).alias("matched_on"),
    )
    return open_rows.join(compared, POSTING_KEY, "left").withColumn(
        "disposition",
        F.when(F.col("judged"), F.lit("already_judged"))
        .when(F.startswith("reason", F.lit("title")), F.lit("title"))
        .when(F.col("reason").isNotNull(), F.lit("location"))
        .when(F.col("stale"), F.lit("stale"))
        .when(F.col("matched_on").isNull(), F.lit("unmatched"))
        .otherwise(F.lit("candidate")),
    ).drop("judged", "stale")


def disposition_counts(decided: DataFrame, cap: int | None) -> DataFrame:
    """The prefilter funnel as one row."""
    def how_many(*names: str) -> Column:
        return F.count_if(F.col("disposition").isin(*names))

    counted = decided.agg(
        F.count(F.lit(1)).alias("open_postings"),
        F.count_if(F.col("disposition") != "already_judged").alias("unjudged_postings"),
        how_many("already_judged").alias("already_judged"),
        how_many("title").alias("eliminated_title"),
        how_many("location").alias("eliminated_location"),
        how_many("stale").alias("stale"),
        how_many("unmatched").alias("unmatched"),
        how_many("candidate").alias("candidates"),
        F.count_distinct(F.when(F.col("disposition") == "candidate", F.col("content_hash"))).alias("distinct_texts"),
    )
    beyond = F.lit(0).cast("bigint") if cap is None else F.greatest(F.col("distinct_texts") - cap, F.lit(0))
    return counted.withColumn("carried_over", beyond)
