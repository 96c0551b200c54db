"""Declared schemas and vocabularies of the stored tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

# The vocabularies the stored columns may hold.
ATS_TYPES = ["greenhouse", "lever", "ashby", "workday"]
SOURCES = ["greenhouse", "lever", "ashby", "workday", "hn", "remoteok", "arbeitnow", "remotive"]
TIERS = ["lab", "bigtech", "infra", "discovered"]
WORK_MODES = ["onsite", "hybrid", "remote", "unknown"]
LOCATION_FITS = ["priority", "acceptable", "unknown", "excluded"]
WORK_AUTHORIZATIONS = ["eligible", "unclear", "blocked"]
APPLICATION_STATUSES = [
    "interested", "applied", "in_process", "rejected", "offer", "withdrawn", "ghosted", "dismissed",
]
EVENT_KINDS = [
    "applied", "recruiter_screen", "technical", "onsite", "offer", "rejected", "withdrawn",
    "ghosted", "note",
]
FETCH_STATUSES = ["ok", "failed"]
DIGEST_SECTIONS = ["priority", "acceptable", "worth_checking", "follow_up", "still_open"]
CANDIDATE_STATUSES = ["pending", "approved", "rejected"]

VOCABULARIES = {
    "ats_type": ATS_TYPES,
    "source": SOURCES,
    "tier": TIERS,
    "work_mode": WORK_MODES,
    "location_fit": LOCATION_FITS,
    "work_authorization": WORK_AUTHORIZATIONS,
    "application_status": APPLICATION_STATUSES,
    "event": EVENT_KINDS,
    "fetch_status": FETCH_STATUSES,
    "section": DIGEST_SECTIONS,
    "candidate_status": CANDIDATE_STATUSES,
}


@cache
def struct_of(ddl: str) -> T.StructType:
    """A declared schema as a type. Needs a running session, so it is called late."""
    return T.StructType.fromDDL(ddl)


LANDED = (
    "source STRING, company_slug STRING, fetched_at TIMESTAMP, http_status INT, body STRING"
)

POSTING = (
    "source STRING, source_job_id STRING, title STRING, url STRING, location_raw STRING, "
    "description STRING, raw STRING, country_code STRING, workplace_type STRING, "
    "is_remote BOOLEAN, location_hints ARRAY<STRING>, posted_at TIMESTAMP, company_name STRING"
)

LOCATION = "regions ARRAY<STRING>, region STRING, work_mode STRING"

EVIDENCE = "ARRAY<STRUCT<source: STRING, source_job_id: STRING, title: STRING, url: STRING, seen: TIMESTAMP>>"

TABLES: dict[str, str] = {
    "companies": (
        "slug STRING, name STRING, ats_type STRING, ats_config MAP<STRING, STRING>, tier STRING, "
        "active BOOLEAN, created_at TIMESTAMP"
    ),
    "postings": (
        "company_slug STRING, job_key STRING, source STRING, source_job_id STRING, url STRING, "
        "raw_hash STRING, content_hash STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, is_open BOOLEAN"
    ),
    # What a posting was read from, one row per payload it has had; `raw_hash` says which is its own.
    "payloads": "source STRING, source_job_id STRING, raw_hash STRING, raw STRING",
    "jobs": (
        "job_key STRING, canonical_key STRING, company_slug STRING, title STRING, "
        "location_raw STRING, region STRING, regions ARRAY<STRING>, work_mode STRING, "
        "description STRING, apply_url STRING, content_hash STRING, primary_source STRING, "
        "primary_source_job_id STRING, posted_at TIMESTAMP, first_seen TIMESTAMP, "
        "last_seen TIMESTAMP"
    ),
    "scores": (
        "source STRING, source_job_id STRING, content_hash STRING, prompt_version INT, score INT, "
        "summary STRING, rationale STRING, matched_areas ARRAY<STRING>, concerns ARRAY<STRING>, "
        "work_authorization STRING, location_fit STRING, model STRING, scored_at TIMESTAMP"
    ),
    "applications": (
        "job_key STRING, status STRING, applied_at TIMESTAMP, created_at TIMESTAMP"
    ),
    "application_events": (
        "job_key STRING, event STRING, occurred_at TIMESTAMP, notes STRING, seq BIGINT"
    ),
    "digest_appearances": (
        "job_key STRING, digest_date DATE, section STRING, position BIGINT, "
        "score_at_appearance INT, content_hash_at_appearance STRING"
    ),
    "fetch_runs": (
        "company_slug STRING, source STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
        "status STRING, item_count BIGINT, error STRING"
    ),
    "candidate_companies": (
        "name STRING, name_key STRING, status STRING, ats_type STRING, ats_token STRING, "
        "board_url STRING, board_jobs BIGINT, probed_at TIMESTAMP, careers_url STRING, "
        f"roles ARRAY<STRING>, evidence {EVIDENCE}, sightings BIGINT, first_seen TIMESTAMP, "
        "last_seen TIMESTAMP, decided_at TIMESTAMP, slug STRING"
    ),
}

# The key each table is unique on; the merge key of every upsert.
KEYS: dict[str, list[str]] = {
    "companies": ["slug"],
    "postings": ["source", "source_job_id"],
    "jobs": ["canonical_key"],
    "scores": ["source", "source_job_id", "content_hash", "prompt_version"],
    "applications": ["job_key"],
    "digest_appearances": ["job_key", "digest_date"],
    "candidate_companies": ["name_key"],
}

VERDICT = (
    "band STRING, score INT, summary STRING, rationale STRING, matched_areas ARRAY<STRING>, "
    "concerns ARRAY<STRING>, work_authorization STRING, input_tokens BIGINT, "
    "output_tokens BIGINT, cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, "
    "error STRING"
)

EXTRACTION = "company STRING, roles ARRAY<STRING>, careers_url STRING, error STRING"

TIER_SUGGESTION = "tier STRING, because STRING, error STRING"
