"""Snapshots against stored state: insert, refresh, close, reopen, re-point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .prefilter import POSTING_KEY

BOARD = ["company_slug", "source"]
# What a poll compares and stores of a sighting; payloads never meet the stored postings.
SIGHTING = ["company_slug", "url", "raw_hash", "content_hash"]
PAYLOAD = [*POSTING_KEY, "raw_hash"]


def good_boards(fetch_runs: DataFrame) -> DataFrame:
    """Boards that answered with at least one posting: the only ones that may close any."""
    return fetch_runs.where("status = 'ok' AND item_count > 0").select(*BOARD).distinct()


def latest_sightings(snapshot: DataFrame) -> DataFrame:
    """One row per posting key and company, the last one listed; a board may repeat an id.

    `max_by` combines on the map side, so a key repeated very often stays cheap.
    """
    key = [*POSTING_KEY, "company_slug"]
    others = [c for c in snapshot.columns if c not in key]
    order = F.struct(*[c for c in ("fetched_at", "position") if c in others] or [F.lit(0)])
    return (
        snapshot.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*key, "_row.*")
    )


def owned_sightings(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows whose company may have the key: one row per key.

    A key belongs to the company stored for it. A key nobody has yet goes to the first
    company by slug that lists it.
    """
    owners = state.select(*POSTING_KEY, F.col("company_slug").alias("_owner"))
    others = [c for c in snapshot.columns if c not in POSTING_KEY]
    return (
        snapshot.join(owners, POSTING_KEY, "left")
        .where("_owner IS NULL OR _owner <=> company_slug")
        .groupBy(*POSTING_KEY)
        .agg(F.min_by(F.struct(*others), "company_slug").alias("_row"))
        .select(*POSTING_KEY, "_row.*")
    )


def refused_sightings(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows refused because another company has their key."""
    return snapshot.join(
        owned_sightings(state, snapshot).select(*POSTING_KEY, "company_slug"),
        [*POSTING_KEY, "company_slug"], "left_anti",
    )


def reconcile(state: DataFrame, snapshot: DataFrame, fetch_runs: DataFrame, now: Column) -> DataFrame:
    """Stored postings after one poll, with a `change` column saying what happened to each.

    `snapshot` has one row per posting key and company with url, raw_hash and content_hash
    (`latest_sightings`). A board that failed, or answered with nothing, changes nothing. A
    key another company owns is left to that company. Only keys, hashes and flags are
    shuffled; `fresh_payloads` are what is to be stored of the payloads.
    """
    good = good_boards(fetch_runs)
    narrow = snapshot.select(*POSTING_KEY, *SIGHTING)
    listed = owned_sightings(state, narrow.join(good, BOARD, "left_semi")).select(
        *POSTING_KEY, *[F.col(c).alias(f"_new_{c}") for c in SIGHTING], F.lit(True).alias("_listed"),
    )
    # Whether a stored row's board spoke this time. Boards are few next to postings; Spark
    # broadcasts them while they are small and splits a hot board otherwise.
    stored = state.withColumn("_stored", F.lit(True)).join(good.withColumn("_good", F.lit(True)), BOARD, "left")
    both = stored.join(listed, POSTING_KEY, "full_outer")

    new = F.col("_stored").isNull()
    seen = F.col("_listed").isNotNull() & ~new
    raw_changed = seen & ~F.col("raw_hash").eqNullSafe(F.col("_new_raw_hash"))
    text_changed = seen & ~F.col("content_hash").eqNullSafe(F.col("_new_content_hash"))
    gone = ~new & F.col("_listed").isNull() & F.coalesce("_good", F.lit(False)) & F.col("is_open")

    def take(column: str, when_changed: Column) -> Column:
        return F.when(new | when_changed, F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column)

    carried = [c for c in state.columns if c not in (*POSTING_KEY, *SIGHTING, "first_seen", "last_seen", "is_open")]
    moment = now.cast("timestamp")
    return both.select(
        F.when(new, F.col("_new_company_slug")).otherwise(F.col("company_slug")).alias("company_slug"),
        *POSTING_KEY,
        *carried,
        take("url", raw_changed), take("raw_hash", raw_changed), take("content_hash", text_changed),
        F.when(new, moment).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(new | seen, moment).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(new | seen, F.lit(True)).when(gone, F.lit(False)).otherwise(F.col("is_open")).alias("is_open"),
        F.when(new, F.lit("new")).when(raw_changed, F.lit("updated"))
        .when(seen, F.lit("seen")).when(gone, F.lit("closed")).otherwise(F.lit("untouched")).alias("change"),
    )


def fresh_payloads(before: DataFrame, after: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The payloads that `after` refers to and `before` did not, of the rows of `snapshot`.

    Which ones is told by keys and hashes alone; only their payloads are read.
    """
    own = [*PAYLOAD, "company_slug"]
    wanted = after.select(*own).join(before.select(*own), own, "left_anti")
    return snapshot.join(wanted, own, "left_semi").groupBy(*PAYLOAD).agg(F.min("raw").alias("raw"))


def with_payloads(postings: DataFrame, payloads: DataFrame) -> DataFrame:
    """Postings with the payload (`raw`) they were last read from."""
    return postings.join(payloads, PAYLOAD)


def good_polls(fetch_runs: DataFrame) -> DataFrame:
    """(board, fetched_at) of the polls that answered with at least one posting."""
    return fetch_runs.where("status = 'ok' AND item_count > 0").select(*BOARD, "fetched_at").distinct()


def due_polls(state: DataFrame, fetch_runs: DataFrame) -> DataFrame:
    """Good polls newer than what the state has of their board; older ones come too late.

    A good poll sees at least one posting, so a board's newest `last_seen` is its last one.
    """
    known = state.where("company_slug IS NOT NULL").groupBy(*BOARD).agg(F.max("last_seen").alias("_known"))
    return good_polls(fetch_runs).join(known, BOARD, "left").where("_known IS NULL OR fetched_at > _known").drop("_known")


def collapse_polls(snapshots: DataFrame, polls: DataFrame) -> DataFrame:
    """Several polls of each board as one set of sightings, without replaying them in turn.

    `snapshots` carry `fetched_at` and hold rows of `polls` only. Per posting: first and last
    time seen, whether the last poll of its board still listed it, and the newest hashes.
    """
    last = polls.groupBy(*BOARD).agg(F.max("fetched_at").alias("last_good"))
    others = [c for c in snapshots.columns if c not in (*POSTING_KEY, "fetched_at")]
    seen = snapshots.groupBy(*POSTING_KEY).agg(
        F.min("fetched_at").alias("first_seen"),
        F.max("fetched_at").alias("last_seen"),
        F.max_by(F.struct(*others), "fetched_at").alias("_row"),
    ).select(*POSTING_KEY, "first_seen", "last_seen", "_row.*")
    return seen.join(last, BOARD).withColumn("is_open", F.col("last_seen") == F.col("last_good")).drop("last_good")


def reconcile_polls(state: DataFrame, snapshots: DataFrame, fetch_runs: DataFrame) -> DataFrame:
    """`reconcile` for a batch holding several polls, equal to applying them in order.

    Each poll's moment is its `fetched_at`. Rows that a failed poll left behind count for
    nothing, neither as sightings nor as claims; a poll older than the state is left out.
    """
    polls = due_polls(state, fetch_runs)
    snapshots = snapshots.select(*POSTING_KEY, *SIGHTING, "fetched_at").join(polls, [*BOARD, "fetched_at"], "left_semi")
    # A key belongs to the company stored for it, else to the one that listed it first.
    claims = (
        snapshots.select(*POSTING_KEY, "company_slug", "fetched_at", F.lit(1).alias("rank"))
        .unionByName(state.where("company_slug IS NOT NULL").select(
            *POSTING_KEY, "company_slug", F.col("first_seen").alias("fetched_at"), F.lit(0).alias("rank")))
    )
    owners = claims.groupBy(*POSTING_KEY).agg(
        F.min_by("company_slug", F.struct("rank", "fetched_at", "company_slug")).alias("company_slug")
    )
    polled_boards = polls.select(*BOARD).distinct()
    own = snapshots.join(owners, [*POSTING_KEY, "company_slug"], "left_semi")
    batch = collapse_polls(own, polls).select(
        *POSTING_KEY,
        *[F.col(c).alias(f"_new_{c}") for c in (*SIGHTING, "first_seen", "last_seen", "is_open")],
    )
    both = state.withColumn("_stored", F.lit(True)).join(
        polled_boards.withColumn("_good", F.lit(True)), BOARD, "left"
    ).join(batch, POSTING_KEY, "full_outer")
    new, seen = F.col("_stored").isNull(), F.col("_new_last_seen").isNotNull()
    raw_changed = new | (seen & ~F.col("raw_hash").eqNullSafe(F.col("_new_raw_hash")))

    def newest(column: str, condition: Column) -> Column:
        return F.when(condition, F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column)

    carried = [c for c in state.columns if c not in (*POSTING_KEY, *SIGHTING, "first_seen", "last_seen", "is_open")]
    return both.select(
        newest("company_slug", new), *POSTING_KEY, *carried,
        newest("url", raw_changed), newest("raw_hash", raw_changed), newest("content_hash", seen),
        newest("first_seen", new), newest("last_seen", seen),
        F.when(seen, F.col("_new_is_open")).when(F.col("_good"), F.lit(False))
        .otherwise(F.col("is_open")).alias("is_open"),
    )


def sync_companies(companies: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """The company table mirroring the watchlist: upsert by slug, deactivate what left it."""
    listed = watchlist.select(
        "slug", *[F.col(c).alias(f"_new_{c}") for c in ("name", "ats_type", "ats_config", "tier", "active")],
        F.lit(True).alias("_listed"),
    )
    both = companies.withColumn("_stored", F.lit(True)).join(listed, "slug", "full_outer")

    def current(column: str) -> Column:
        return F.when(F.col("_listed"), F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column)

    return both.select(
        "slug", current("name"), current("ats_type"), current("ats_config"), current("tier"),
        F.when(F.col("_listed"), F.col("_new_active")).otherwise(F.lit(False)).alias("active"),
        F.when(F.col("_stored").isNull(), now.cast("timestamp")).otherwise(F.col("created_at")).alias("created_at"),
    )


def repoint(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs moved off a closed primary posting onto their oldest open one.

    A job whose postings are all closed keeps its primary. Adds `repointed`.
    """
    primary = postings.select(
        F.col("source").alias("primary_source"), F.col("source_job_id").alias("primary_source_job_id"),
        F.col("is_open").alias("_primary_open"),
    )
    oldest = (
        postings.where("is_open AND job_key IS NOT NULL")
        .groupBy("job_key")
        .agg(F.min(F.struct("first_seen", *POSTING_KEY)).alias("_oldest"))
    )
    moved = (
        F.col("primary_source_job_id").isNotNull()
        & ~F.coalesce("_primary_open", F.lit(False))
        & F.col("_oldest").isNotNull()
    )
    return (
        jobs.join(primary, ["primary_source", "primary_source_job_id"], "left")
        .join(oldest, "job_key", "left")
        .withColumn("repointed", moved)
        .withColumn("primary_source", F.when(moved, F.col("_oldest.source")).otherwise(F.col("primary_source")))
        .withColumn("primary_source_job_id", F.when(moved, F.col("_oldest.source_job_id"))
                    .otherwise(F.col("primary_source_job_id")))
        .drop("_primary_open", "_oldest")
    )


def refresh_jobs(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Displayed fields from the primary posting, only where its text changed.

    `postings` carry their replayed record and `location`. Every posting of a job bumps
    `last_seen` and may bring an earlier `posted_at`; only the primary rewrites the rest.
    """
    seen = postings.where("job_key IS NOT NULL").groupBy("job_key").agg(
        F.max("last_seen").alias("_last_seen"), F.min("posted_at").alias("_posted_at")
    )
    shown = postings.select(
        F.col("source").alias("primary_source"), F.col("source_job_id").alias("primary_source_job_id"),
        F.col("content_hash").alias("_hash"), F.col("title").alias("_title"),
        F.col("location_raw").alias("_location_raw"), F.col("location").alias("_location"),
        F.col("description").alias("_description"), F.col("url").alias("_url"),
    )
    both = jobs.join(shown, ["primary_source", "primary_source_job_id"], "left").join(seen, "job_key", "left")
    changed = F.col("_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    moved = F.col("repointed") if "repointed" in jobs.columns else F.lit(False)

    def shown_as(column: str, value: Column, condition: Column = changed) -> Column:
        return F.when(condition, value).otherwise(F.col(column)).alias(column)

    replaced = {
        "title": shown_as("title", F.col("_title")),
        "location_raw": shown_as("location_raw", F.col("_location_raw")),
        "region": shown_as("region", F.col("_location.region")),
        "regions": shown_as("regions", F.col("_location.regions")),
        "work_mode": shown_as("work_mode", F.col("_location.work_mode")),
        "description": shown_as("description", F.col("_description")),
        # A job that just moved links to its new posting even when the words are the same.
        "apply_url": F.when(changed, F.col("_url")).when(moved, F.coalesce("_url", "apply_url"))
        .otherwise(F.col("apply_url")).alias("apply_url"),
        "content_hash": shown_as("content_hash", F.col("_hash")),
        "last_seen": F.greatest("last_seen", "_last_seen").alias("last_seen"),
        "posted_at": F.least("posted_at", "_posted_at").alias("posted_at"),
    }
    return both.select(*[replaced.get(c, F.col(c)) for c in jobs.columns])


def board_report(
    reconciled: DataFrame, fetch_runs: DataFrame, refused: DataFrame, new_jobs: DataFrame, repointed: DataFrame
) -> DataFrame:
    """Ingest counters per board, and the totals as the row whose board is null.

    `refused`, `new_jobs` and `repointed` hold (company_slug, source), one row per case.
    """
    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.select(*BOARD, F.lit(name).alias("counter"), F.lit(1).cast("bigint").alias("n"))

    named = {"new": "new_postings", "updated": "updated", "closed": "closed"}
    changes = reconciled.where(F.col("change").isin(list(named))).select(
        *BOARD,
        F.coalesce(*[F.when(F.col("change") == k, F.lit(v)) for k, v in named.items()]).alias("counter"),
        F.lit(1).cast("bigint").alias("n"),
    )
    fetched = fetch_runs.select(
        *BOARD, F.lit("fetched").alias("counter"), F.coalesce("item_count", F.lit(0)).cast("bigint").alias("n"))
    failed = tally(fetch_runs.where("status = 'failed'"), "failed")
    cases = {"skipped": refused, "new_jobs": new_jobs, "repointed": repointed}
    counters = ["fetched", "failed", *named.values(), *cases]
    rows = changes.unionByName(fetched).unionByName(failed)
    for name, df in cases.items():
        rows = rows.unionByName(tally(df, name))
    summed = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in counters]
    return rows.groupingSets([[F.col(c) for c in BOARD], []], *BOARD).agg(*summed)
