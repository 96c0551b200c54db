"""One ingest run: landed responses to postings and openings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash, raw_hash
from ..operators import reconcile as R
from ..operators.places import parse_locations
from ..operators.prefilter import POSTING_KEY
from ..operators.resolve import merge_openings, resolve_openings, retaken_keys, survivors, ranked_jobs
from ..schemas import TABLES, struct_of
from ..session import cut
from ..sources.readers import BOARD_SOURCES, append_runs, read_sources, replay
from ..sources.store import State


# What a job's display needs of a posting.
RECORD = [*POSTING_KEY, "job_key", "content_hash", "title", "location_raw", "location", "description", "url",
          "posted_at", "last_seen"]


@dataclass(frozen=True)
class IngestRun:
    """The state after the run and the counters per board."""

    state: State
    report: DataFrame


def prepare_snapshot(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Posting records with their company, parsed location and both hashes, one row per key and company."""
    named = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"))
    located = parse_locations(R.latest_sightings(records).join(named, "company_slug"))
    return located.withColumn("raw_hash", raw_hash(F.col("raw"))).withColumn(
        "content_hash",
        content_hash(F.col("company"), F.col("title"), F.col("location_raw"), F.col("description")),
    )


def _jobs_named(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return jobs.join(companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company")), "company_slug")


def run_ingest(
    state: State, landed: DataFrame, watchlist: DataFrame, now: Column, only: list[str] | None = None
) -> IngestRun:
    """Reconciles one poll of every active board and resolves what it listed.

    `only` narrows the boards by company slug and never enables one.
    """
    moment = now.cast("timestamp")
    companies = cut(R.sync_companies(state.companies, watchlist, now))
    polled = companies.where("active").select(F.col("slug").alias("company_slug"))
    if only is not None:
        polled = polled.where(F.col("company_slug").isin(only))
    records, runs = read_sources(landed.join(polled, "company_slug", "left_semi"), only=list(BOARD_SOURCES))
    runs = cut(runs)
    snapshot = cut(prepare_snapshot(records, companies))

    reconciled = cut(R.reconcile(state.postings, snapshot, runs, now))
    payloads = cut(R.fresh_payloads(state.postings, reconciled, snapshot))
    refused = R.refused_sightings(state.postings, snapshot)
    listed = reconciled.where("change IN ('new', 'seen', 'updated')").select(
        *POSTING_KEY, "company_slug", "job_key", "first_seen", "last_seen")
    shown = cut(listed.join(
        snapshot.select(*POSTING_KEY, "company_slug", "company", "title", "location", "location_raw",
                        "description", "url", "posted_at", "content_hash"),
        [*POSTING_KEY, "company_slug"],
    ))
    resolution = resolve_openings(
        shown.withColumn("region", F.col("location.region")), _jobs_named(state.jobs, companies))

    assigned = resolution.assignments.select(*POSTING_KEY, F.col("job_key").alias("_job"))
    postings = reconciled.drop("change").join(assigned, POSTING_KEY, "left").withColumn(
        "job_key", F.coalesce("_job", "job_key")).drop("_job")

    founded = resolution.created.drop("job_key").join(shown.drop("job_key"), POSTING_KEY).join(
        resolution.created.select(*POSTING_KEY, "job_key"), POSTING_KEY)
    created = founded.select(
        "job_key", "canonical_key", "company_slug", "title", "location_raw", F.col("location.region").alias("region"),
        F.col("location.regions").alias("regions"), F.col("location.work_mode").alias("work_mode"), "description",
        F.col("url").alias("apply_url"), "content_hash", F.col("source").alias("primary_source"),
        F.col("source_job_id").alias("primary_source_job_id"), "posted_at",
        moment.alias("first_seen"), moment.alias("last_seen"),
    )
    jobs = cut(retaken_keys(state.jobs.unionByName(created), resolution.renamed))

    applications, appearances = state.applications, state.digest_appearances
    if not resolution.merges.isEmpty():
        scored = state.scores.select(*POSTING_KEY).distinct().join(postings.select(*POSTING_KEY, "job_key"), POSTING_KEY)
        plan = survivors(resolution.merges, ranked_jobs(jobs, applications, scored))
        merged = merge_openings(plan, jobs, postings, applications, appearances)
        # The survivor takes the key of the posting that caused the merge, where it is free.
        wanted = resolution.merges.join(plan, plan["job_key"] == F.col("merged_into")).groupBy("survivor").agg(
            F.max_by("canonical_key", F.struct(*POSTING_KEY)).alias("canonical_key")
        ).withColumnRenamed("survivor", "job_key")
        jobs = retaken_keys(merged.jobs, wanted)
        postings, applications, appearances = merged.postings, merged.applications, merged.appearances
    postings = cut(postings)

    pointed = cut(R.repoint(jobs, postings))
    moved = pointed.where("repointed").select(
        F.col("primary_source").alias("source"), F.col("primary_source_job_id").alias("source_job_id"))
    fresh = shown.drop("job_key").join(postings.select(*POSTING_KEY, "job_key"), POSTING_KEY).select(*RECORD)
    if not moved.isEmpty():
        # A job that moved is re-derived from the stored payload of its new posting.
        held = postings.join(moved, POSTING_KEY, "left_semi").select("job_key", *POSTING_KEY, "raw_hash", "content_hash")
        stored = R.with_payloads(held, state.all_payloads().unionByName(payloads)).drop("raw_hash")
        adopted = parse_locations(replay(stored, BOARD_SOURCES)).withColumn("last_seen", moment).select(*RECORD)
        fresh = fresh.join(moved, POSTING_KEY, "left_anti").unionByName(adopted)
    refreshed = R.refresh_jobs(pointed, fresh)

    board = ["company_slug", "source"]
    new_jobs = founded.select(*board)
    repointed = pointed.where("repointed").select("company_slug", F.col("primary_source").alias("source"))
    report = R.board_report(reconciled, runs, refused, new_jobs, repointed)

    def stored(df: DataFrame, table: str) -> DataFrame:
        return df.select(*struct_of(TABLES[table]).fieldNames())

    after = state.with_(
        companies=stored(companies, "companies"),
        postings=stored(postings, "postings"),
        payloads=state.payloads,
        new_payloads=stored(state.new_payloads.unionByName(payloads), "payloads"),
        jobs=cut(stored(refreshed, "jobs")),
        applications=stored(applications, "applications"),
        digest_appearances=stored(appearances, "digest_appearances"),
        fetch_runs=append_runs(state.fetch_runs, runs),
    )
    return IngestRun(after, report)
