"""One discovery run: aggregator listings to candidate companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash, raw_hash, render_prose
from ..operators import discovery as D
from ..operators.inference import BatchFunction, extract_companies
from ..operators.prefilter import POSTING_KEY, strong_term, title_exclusion
from ..schemas import TABLES, struct_of
from ..session import cut
from ..sources.readers import DISCOVERY_SOURCES, append_runs, read_sources
from ..sources.store import State


@dataclass(frozen=True)
class DiscoveryRun:
    """The state after the run, what became of each sighting, and the counters per source."""

    state: State
    outcomes: DataFrame
    report: DataFrame


def run_discovery(
    state: State, landed: DataFrame, watchlist: DataFrame, boards: DataFrame, profile,
    extractor: BatchFunction, now: Column, max_extractions: int | None, reprobe_after_days: int,
    only: list[str] | None = None,
) -> DiscoveryRun:
    """Reads the aggregators, remembers what is new, and attaches it to companies.

    `boards` is the directory of known boards. Prose postings name no company; `extractor`
    reads it out of them; with `max_extractions`, of so many, and the rest come back next run.
    """
    moment = now.cast("timestamp")
    names_listed = list(DISCOVERY_SOURCES)
    wanted = [s for s in names_listed if only is None or s in only]
    records, runs = read_sources(landed.where(F.col("source").isin(wanted)), only=wanted)
    runs = cut(runs)
    wanted_rows = records.where(
        title_exclusion(F.col("title"), profile).isNull()
        & strong_term(F.col("title"), F.col("description"), profile).isNotNull()
    )
    # A key listed twice counts where it stands first.
    others = [c for c in wanted_rows.columns if c not in POSTING_KEY]
    kept = cut(
        wanted_rows.groupBy(*POSTING_KEY).agg(F.min_by(F.struct(*others), F.struct("position", "raw")).alias("_row"))
        .select(*POSTING_KEY, "_row.*").select(*wanted_rows.columns)
    )
    fresh = cut(D.new_sightings(kept, state.postings))

    prose = fresh.where("company_name IS NULL").withColumn("text", render_prose(F.col("description")))
    answers = extract_companies(
        prose.select(*POSTING_KEY, "position", "text"), extractor, max_extractions,
        [F.array_position(F.array(*[F.lit(s) for s in names_listed]), F.col("source")), F.col("position"), *POSTING_KEY])
    answered = answers.where("error IS NULL")
    capped = prose.join(answers, POSTING_KEY, "left_anti")
    named = fresh.where("company_name IS NOT NULL").withColumn("name", F.col("company_name")).withColumn(
        "roles", F.array("title")).withColumn("careers_url", F.lit(None).cast("string"))
    read = fresh.join(answered, POSTING_KEY).withColumnRenamed("company", "name")
    columns = [*POSTING_KEY, "position", "name", "roles", "careers_url", "title", "url", "raw", "location_raw", "description"]
    sightings = cut(named.select(*columns).unionByName(read.select(*columns)))

    candidates = D.approve_watched(state.candidate_companies, watchlist, now)
    attached = D.attach_candidates(
        sightings, candidates, D.watched_names(watchlist, state.companies),
        D.watched_boards(watchlist, state.companies), boards, now, reprobe_after_days)
    columns = struct_of(TABLES["postings"]).fieldNames()
    hashed = sightings.withColumn("raw_hash", raw_hash(F.col("raw")))
    remembered = hashed.select(
        F.lit(None).cast("string").alias("company_slug"), F.lit(None).cast("string").alias("job_key"),
        *POSTING_KEY, "url", "raw_hash",
        content_hash(F.col("name"), F.col("title"), F.col("location_raw"), F.col("description")).alias("content_hash"),
        moment.alias("first_seen"), moment.alias("last_seen"), F.lit(True).alias("is_open"),
    )
    found = attached.candidates.where(F.col("probed_at") == moment).where("ats_type IS NOT NULL").select("name_key")
    boarded = attached.outcomes.join(found, F.col("candidate_key") == found["name_key"], "left_semi").dropDuplicates(["candidate_key"])
    report = D.discovery_report(runs, kept, fresh, answers, capped, attached.outcomes, boarded)
    after = state.with_(
        postings=D.touch_seen(state.postings, kept, now).unionByName(remembered).select(*columns),
        new_payloads=state.new_payloads.unionByName(hashed.select(*POSTING_KEY, "raw_hash", "raw")),
        candidate_companies=attached.candidates,
        fetch_runs=append_runs(state.fetch_runs, runs),
    )
    return DiscoveryRun(after, attached.outcomes, report)


