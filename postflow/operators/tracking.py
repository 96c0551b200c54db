"""Applications: folding the action log, and the funnel and response figures over it.

The fold needs no state machine. `sent` is absorbing: the first apply always sends, and
nothing unsends. Before that a job is only open or dismissed, which the last dismissal or
its undoing tells. So every decision is a comparison with a few per-job aggregates, and a
job with very many events is aggregated like any other group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scans import STRETCH, last_before
from ..schemas import EVENT_KINDS
from ..session import cut
from .prefilter import POSTING_KEY

# What a step does to the status, which steps repeat, which end or answer.
EVENT_STATUS = {
    "applied": "applied", "recruiter_screen": "in_process", "technical": "in_process",
    "onsite": "in_process", "offer": "offer", "rejected": "rejected", "withdrawn": "withdrawn",
    "ghosted": "ghosted",
}
REPEATABLE_EVENTS = ["recruiter_screen", "technical", "onsite"]
RESPONSE_EVENTS = ["recruiter_screen", "technical", "onsite", "offer", "rejected"]
ENDED_STATUSES = ["offer", "rejected", "withdrawn", "ghosted"]
FUNNEL_STAGES = ["applied", "recruiter_screen", "technical", "onsite", "offer"]
FUNNEL_ENDINGS = ["rejected", "ghosted", "withdrawn"]
PIPELINE_ORDER = ["interested", "applied", "in_process", "offer", "rejected", "ghosted", "withdrawn"]
NOT_SENT = ["interested", "dismissed"]
ACTIONS = ["apply", "dismiss", "undismiss"]
DEFERRED_ACTIONS = ["draft_cv", "draft_cover_letter"]

MICROS_PER_DAY = 86_400_000_000


def status_of(event: Column) -> Column:
    """The status a step leads to; null for notes."""
    return F.coalesce(*[F.when(event == e, F.lit(s)) for e, s in EVENT_STATUS.items()])


def repeat_bucket(event: Column, occurred_at: Column) -> Column:
    """Steps of one kind sharing a bucket are the same step; null for notes, which never are.

    Repeatable steps count once per UTC day, the others once ever.
    """
    day = F.floor(F.unix_micros(occurred_at) / MICROS_PER_DAY)
    return F.when(event == "note", F.lit(None).cast("bigint")).when(
        event.isin(REPEATABLE_EVENTS), day).otherwise(F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Fold:
    """applications and events after the log; outcomes has one row per log entry; added are the events that are new."""

    applications: DataFrame
    events: DataFrame
    outcomes: DataFrame
    added: DataFrame


def fold_events(
    log: DataFrame, applications: DataFrame | None = None, events: DataFrame | None = None, stretch: int = STRETCH
) -> Fold:
    """Applies a log of actions and steps to the stored applications and events.

    `log`: job_key, action (apply, dismiss, undismiss, or a step name), occurred_at, seq,
    notes. `seq` is the arrival order; the last step recorded decides the status, whatever
    day it is dated. An outcome is `changed` with a reason that says what happened or why
    the entry was refused.
    """
    spark = log.sparkSession
    if applications is None:
        applications = spark.createDataFrame([], "job_key STRING, status STRING, applied_at TIMESTAMP, created_at TIMESTAMP")
    if events is None:
        events = spark.createDataFrame([], "job_key STRING, event STRING, occurred_at TIMESTAMP, notes STRING, seq BIGINT")

    action = F.col("action")
    step = action.isin(EVENT_KINDS)
    before = applications.select("job_key", F.col("status").alias("old_status"))
    entries = log.select("job_key", "action", "occurred_at", F.col("seq").cast("bigint").alias("seq"), "notes")
    toggle = F.when(action.isin("dismiss", "undismiss"), action)
    seen = last_before(entries, "job_key", "seq", toggle, "last_toggle", stretch).join(before, "job_key", "left")

    was_sent = F.col("old_status").isNotNull() & ~F.col("old_status").isin(NOT_SENT)
    # Before anything was sent: dismissed by the last toggle, else as stored.
    dismissed = F.coalesce(F.col("last_toggle") == "dismiss", F.col("old_status") == "dismissed", F.lit(False))
    # A stored interest lasts until the first dismissal; undoing that removes the row.
    dismissals = entries.where(action == "dismiss").groupBy("job_key").agg(F.min("seq").alias("first_dismiss"))
    seen = seen.join(dismissals, "job_key", "left")
    interested = F.coalesce(F.col("old_status") == "interested", F.lit(False)) & F.coalesce(
        F.col("seq") <= F.col("first_dismiss"), F.lit(True))

    sends = (action == "apply") | (step & (action != "note") & interested)
    sent_at = seen.where(sends & ~F.coalesce(was_sent, F.lit(False))).groupBy("job_key").agg(F.min("seq").alias("sent_seq"))
    placed = (
        seen.withColumn("dismissed", dismissed)
        .withColumn("interested", interested)
        .withColumn("was_sent", F.coalesce(was_sent, F.lit(False)))
        .join(sent_at, "job_key", "left")
        .withColumn("sent", F.col("was_sent") | F.coalesce(F.col("sent_seq") < F.col("seq"), F.lit(False)))
    )
    takes_step = step & (F.col("sent") | F.col("interested"))
    # What each entry would add to the timeline: a taken step, or the `applied` of the apply
    # that sends.
    applies = (action == "apply") & ~F.col("sent")
    placed = placed.withColumn(
        "adds", F.when(applies, F.lit("applied")).when(takes_step, action)
    ).withColumn("bucket", F.when(F.col("adds").isNotNull(), repeat_bucket(F.col("adds"), F.col("occurred_at"))))

    # The first entry of each (job, step, bucket) stands, unless the timeline already has it.
    firsts = placed.where("bucket IS NOT NULL").groupBy("job_key", "adds", "bucket").agg(F.min("seq").alias("first_seq"))
    stored_steps = events.select(
        "job_key", F.col("event").alias("adds"), repeat_bucket(F.col("event"), F.col("occurred_at")).alias("bucket"),
    ).where("bucket IS NOT NULL").distinct().withColumn("_stored", F.lit(True))
    firsts = firsts.join(stored_steps, ["job_key", "adds", "bucket"], "left")
    judged = placed.join(firsts, ["job_key", "adds", "bucket"], "left").withColumn(
        "accepted",
        F.col("adds").isNotNull()
        & (F.col("bucket").isNull() | (F.col("_stored").isNull() & (F.col("seq") == F.col("first_seq")))),
    )

    reason = (
        F.when(action.isin(DEFERRED_ACTIONS), F.lit("refused: not available"))
        .when(applies, F.lit("applied"))
        .when(action == "apply", F.lit("unchanged: already applied"))
        .when(action.isin("dismiss", "undismiss") & F.col("sent"), F.lit("refused: already applied"))
        .when((action == "dismiss") & F.col("dismissed"), F.lit("unchanged: already dismissed"))
        .when(action == "dismiss", F.lit("dismissed"))
        .when((action == "undismiss") & F.col("dismissed"), F.lit("undismissed"))
        .when(action == "undismiss", F.lit("refused: not dismissed"))
        .when(~step, F.lit("refused: unknown step"))
        .when(~takes_step, F.lit("refused: no application"))
        .when(F.col("accepted"), F.lit("recorded"))
        .otherwise(F.lit("refused: already recorded"))
    )
    # Written once; the timeline, the applications and the outcomes are all read from it.
    judged = cut(judged.withColumn("reason", reason).withColumn(
        "changed", F.col("reason").isin("applied", "dismissed", "undismissed", "recorded"),
    ).select("job_key", "seq", "action", "adds", "accepted", "reason", "changed", "occurred_at", "notes"))

    accepted = judged.where("accepted").select(
        "job_key", F.col("adds").alias("event"), "occurred_at",
        F.when(F.col("reason") == "recorded", F.nullif(F.trim("notes"), F.lit(""))).alias("notes"), "seq",
    )
    changes = judged.where("changed").groupBy("job_key").agg(
        F.max_by(
            F.when(F.col("reason") == "applied", F.lit("applied")).when(F.col("reason") == "dismissed", F.lit("dismissed"))
            .when(F.col("reason") == "undismissed", F.lit("gone")).otherwise(status_of(F.col("adds"))),
            F.when((F.col("reason") != "recorded") | (F.col("adds") != "note"), F.col("seq")),
        ).alias("new_status"),
        F.min_by("occurred_at", F.when(F.col("reason") == "applied", F.col("seq"))).alias("apply_at"),
        F.min_by("occurred_at", F.when((F.col("reason") == "recorded") & (F.col("adds") == "applied"), F.col("seq"))).alias("step_at"),
        # The row's age: from its first entry, or from its last re-creation after an undo.
        F.max(F.when(F.col("reason") == "undismissed", F.col("seq"))).alias("undone_seq"),
    )
    created = (
        judged.where("reason IN ('applied', 'dismissed')")
        .join(changes.select("job_key", "undone_seq"), "job_key")
        .where("undone_seq IS NULL OR seq > undone_seq")
        .groupBy("job_key").agg(F.min_by("occurred_at", "seq").alias("opened_at"))
    )
    after = (
        applications.join(changes, "job_key", "full_outer").join(created, "job_key", "left")
        .select(
            "job_key",
            F.coalesce("new_status", "status").alias("status"),
            F.coalesce("apply_at", "applied_at", "step_at").alias("applied_at"),
            F.when(F.col("undone_seq").isNull(), F.coalesce("created_at", "opened_at"))
            .otherwise(F.col("opened_at")).alias("created_at"),
        )
        .where("status <> 'gone'")
    )
    timeline = events.select("job_key", "event", "occurred_at", "notes", "seq").unionByName(accepted)
    outcomes = judged.select("job_key", "seq", "action", "changed", "reason")
    return Fold(after, timeline, outcomes, accepted)


def can_act(cards: DataFrame, action: str) -> DataFrame:
    """Job cards (with `status`) and whether `action` would change anything, without doing it."""
    sent = F.col("status").isNotNull() & ~F.col("status").isin(NOT_SENT)
    dismissed = F.coalesce(F.col("status") == "dismissed", F.lit(False))
    allowed = {
        "apply": ~sent, "dismiss": ~sent & ~dismissed, "undismiss": dismissed,
    }.get(action, F.lit(False))
    return cards.withColumn("allowed", allowed)


# --- figures -----------------------------------------------------------------------------


def application_facts(applications: DataFrame, events: DataFrame) -> DataFrame:
    """Applications not dismissed, with what each ever reached.

    Adds `sent`, `responded`, `standing` and one boolean per step kind.
    """
    reached = events.groupBy("job_key").agg(*[
        F.max(F.col("event") == kind).alias(f"ever_{kind}") for kind in EVENT_KINDS if kind != "note"
    ])
    joined = applications.where("status <> 'dismissed'").join(reached, "job_key", "left")
    for kind in EVENT_KINDS:
        if kind != "note":
            joined = joined.withColumn(f"ever_{kind}", F.coalesce(f"ever_{kind}", F.lit(False)))
    responded = F.lit(False)
    for kind in RESPONSE_EVENTS:
        responded = responded | F.col(f"ever_{kind}")
    return (
        joined.withColumn("sent", F.col("applied_at").isNotNull() | F.col("ever_applied"))
        .withColumn("responded", responded)
        .withColumn("standing", F.when(F.col("status").isin(ENDED_STATUSES), F.col("status"))
                    .when(F.col("responded"), F.lit("in process")))
    )


def pipeline(applications: DataFrame) -> DataFrame:
    """Applications per status in the order a search progresses; statuses nobody has are left out."""
    order = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(PIPELINE_ORDER)],
                       F.lit(len(PIPELINE_ORDER)))
    return (
        applications.where("status <> 'dismissed'").groupBy("status")
        .agg(F.count(F.lit(1)).alias("applications"))
        .withColumn("ordinal", order).orderBy("ordinal", "status")
    )


def funnel(facts: DataFrame, stages: list[str] = FUNNEL_STAGES) -> DataFrame:
    """How many applications ever reached each stage, and their share of the sent ones.

    Every application counts above the line, only sent ones below it. One pass over the facts.
    """
    shown = [s for s in stages if s != "applied"]
    totals = facts.agg(
        F.count_if("sent").alias("sent"), *[F.count_if(f"ever_{s}").alias(s) for s in shown]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("stage"), F.col(s).alias("reached")) for i, s in enumerate(shown)
    ])).alias("row")
    return totals.select("sent", rows).select(
        "row.ordinal", "row.stage", "row.reached",
        F.when(F.col("sent") > 0, F.col("row.reached") / F.col("sent")).otherwise(F.lit(0.0)).alias("share_of_sent"),
    )


def response_rates(facts: DataFrame, slices: list[str]) -> DataFrame:
    """Response rate of sent applications per value of each slice column, and overall.

    All slices in one aggregation; the overall row has slice `all`. Biggest first.
    """
    sets = [[F.col(s)] for s in slices] + [[]]
    kind = F.coalesce(*[F.when(F.grouping(s) == 0, F.lit(s)) for s in slices], F.lit("all"))
    label = F.coalesce(*[F.when(F.grouping(s) == 0, F.col(s)) for s in slices])
    return (
        facts.where("sent").groupingSets(sets, *slices)
        .agg(kind.alias("slice"), label.alias("label"), F.count(F.lit(1)).alias("applied"),
             F.count_if("responded").alias("responded"))
        .select("slice", "label", "applied", "responded",
                F.coalesce(F.try_divide("responded", "applied"), F.lit(0.0)).alias("rate"))
        .orderBy("slice", F.desc("applied"), "label")
    )


def primary_sources(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """(job_key, source): the board a job is displayed from.

    The primary posting's source, else that of its first posting, else `unknown`.
    """
    primary = jobs.select("job_key", F.struct(F.col("primary_source").alias("source"),
                                              F.col("primary_source_job_id").alias("source_job_id")).alias("_primary"))
    ranked = postings.where("job_key IS NOT NULL").join(primary, "job_key").groupBy("job_key").agg(
        F.min_by("source", F.struct(
            (~F.struct(*POSTING_KEY).eqNullSafe(F.col("_primary"))).alias("not_primary"), "first_seen", *POSTING_KEY,
        )).alias("source"))
    return jobs.select("job_key").join(ranked, "job_key", "left").select(
        "job_key", F.coalesce("source", F.lit("unknown")).alias("source"))


def timeline(events: DataFrame) -> DataFrame:
    """Events oldest first per job as rows, with the step's label.

    Rows, not one array per job: notes are unlimited, so an array would have no bound.
    """
    return events.select(
        "job_key", "occurred_at", "seq", "event", F.translate("event", "_", " ").alias("label"), "notes"
    ).orderBy("job_key", "occurred_at", "seq")


def last_events(events: DataFrame) -> DataFrame:
    """The most recent event of every job."""
    return events.groupBy("job_key").agg(
        F.max_by(F.struct("event", "occurred_at", "notes"), F.struct("occurred_at", "seq")).alias("last_event"),
        F.count(F.lit(1)).alias("events"),
    )


def tracked_applications(facts: DataFrame, events: DataFrame, jobs: DataFrame, companies: DataFrame, postings: DataFrame) -> DataFrame:
    """Applications with their job, company, source and last event; newest first."""
    shown = jobs.select("job_key", "title", "company_slug", "apply_url")
    named = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"), "tier")
    return (
        facts.join(shown, "job_key").join(named, "company_slug")
        .join(primary_sources(jobs, postings), "job_key")
        .join(last_events(events), "job_key", "left")
        .withColumn("ended", F.col("status").isin(ENDED_STATUSES))
        .orderBy(F.desc("created_at"), F.desc("job_key"))
    )


def job_cards(jobs: DataFrame, companies: DataFrame, applications: DataFrame, best: DataFrame) -> DataFrame:
    """Jobs with company, application status and best score, linking to the posting that won."""
    named = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("company"))
    status = applications.select("job_key", "status", "applied_at")
    score = best.select("job_key", "score", F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), F.col("url").alias("_won_url"))
    return (
        jobs.select("job_key", "title", "company_slug", "location_raw", "work_mode", "apply_url")
        .join(named, "company_slug").join(status, "job_key", "left").join(score, "job_key", "left")
        .select(
            "job_key", "title", "company",
            F.coalesce(F.nullif("location_raw", F.lit("")), F.lit("not stated")).alias("location"), "work_mode",
            F.coalesce(F.nullif("_won_url", F.lit("")), F.col("apply_url")).alias("apply_url"),
            "score", F.coalesce("summary", F.lit("")).alias("summary"), "status", "applied_at",
            (F.col("status").isNotNull() & (F.col("status") != "interested")).alias("settled"),
        )
    )


def publish_views(**frames: DataFrame) -> None:
    """Registers result frames as temp views, so the same figures are reachable by SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
