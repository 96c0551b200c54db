"""Best score per job, repeat suppression, sections, positions, appearance memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .prefilter import POSTING_KEY, open_attached

SECTIONS = ["priority", "acceptable", "worth_checking"]


def best_scores(scores: DataFrame, postings: DataFrame, version: int) -> DataFrame:
    """The winning verdict per job: highest score, then the earliest row.

    Only verdicts on the current text of an open posting count. The filter on the row
    number lets Spark keep one row per job and task before anything is shuffled, so a job
    with very many postings does not gather in one place.
    """
    current = open_attached(postings).select(*POSTING_KEY, "content_hash", "job_key", "url")
    ranked = scores.where(F.col("prompt_version") == version).join(current, [*POSTING_KEY, "content_hash"])
    order = Window.partitionBy("job_key").orderBy(F.desc("score"), "scored_at", *POSTING_KEY)
    return ranked.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def repeat_state(
    jobs: DataFrame, history: DataFrame, rules, before=None
) -> DataFrame:
    """`jobs` (job_key, score, content_hash, ...) with `appearance`, `demoted`, `suppressed`.

    `appearance` counts this showing: one more than the showings since the last material
    change. A change is another text, or a score that moved by more than the rules allow;
    a showing without a score is no change. `before` leaves out that day and later ones.

    Two pre-aggregated passes (the day of the last change, then the days after it) take the
    place of a running window, so a long history is never sorted in one task.
    """
    shown = history if before is None else history.where(F.col("digest_date") < F.lit(before).cast("date"))
    current = jobs.select("job_key", "score", "content_hash")
    changed = ~F.col("content_hash_at_appearance").eqNullSafe(F.col("content_hash")) | F.coalesce(
        F.abs(F.col("score") - F.col("score_at_appearance")) > rules.reset_on_score_delta, F.lit(False)
    )
    compared = shown.join(current, "job_key").select("job_key", "digest_date", changed.alias("changed"))
    last_change = compared.where("changed").groupBy("job_key").agg(F.max("digest_date").alias("changed_on"))
    since = (
        compared.where("NOT changed")
        .join(last_change, "job_key", "left")
        .where("changed_on IS NULL OR digest_date > changed_on")
        .groupBy("job_key")
        .agg(F.count(F.lit(1)).alias("_shown"))
    )
    appearance = F.coalesce("_shown", F.lit(0)) + 1
    suppressed = F.lit(rules.enabled) & (F.col("appearance") > rules.suppress_after)
    return (
        jobs.join(since, "job_key", "left")
        .withColumn("appearance", appearance)
        .drop("_shown")
        .withColumn("suppressed", suppressed)
        .withColumn("demoted", F.lit(rules.enabled) & (F.col("appearance") > min(rules.demote_after, rules.suppress_after)))
    )


def section_for(fit: Column, work_authorization: Column) -> Column:
    """The section a job is shown in, null when it is not shown at all."""
    return (
        F.when(fit == "excluded", F.lit(None).cast("string"))
        .when(~work_authorization.eqNullSafe(F.lit("eligible")), F.lit("worth_checking"))
        .when(fit == "unknown", F.lit("worth_checking"))
        .otherwise(fit)
    )


def section_note(fit: Column, work_authorization: Column, place: Column, region: Column) -> Column:
    """Why an entry sits in its section when the line above does not show it."""
    elsewhere = F.when(F.coalesce(place != region, F.lit(False)), place)
    via = F.coalesce(F.concat(F.lit(" (via "), elsewhere, F.lit(")")), F.lit(""))
    return (
        F.when(fit == "unknown", F.lit("Location could not be settled."))
        .when(
            ~work_authorization.eqNullSafe(F.lit("eligible")),
            F.concat(F.lit("The location qualifies"), via, F.lit(", but the work authorization is "),
                     work_authorization, F.lit(".")),
        )
        .when(elsewhere.isNotNull(), F.concat(fit, F.lit(" via "), place))
        .otherwise(F.lit(""))
    )


def ordinal(number: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st."""
    last, teens = number % 10, (number % 100).between(11, 13)
    suffix = (
        F.when(teens, F.lit("th")).when(last == 1, F.lit("st")).when(last == 2, F.lit("nd"))
        .when(last == 3, F.lit("rd")).otherwise(F.lit("th"))
    )
    return F.concat(number.cast("string"), suffix)


def repeat_note(appearance: Column, demoted: Column) -> Column:
    """The nudge under a demoted entry."""
    return F.when(demoted, F.concat(ordinal(appearance), F.lit(" time — dismiss?"))).otherwise(F.lit(""))


def positions(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row within its group, for groups of any size.

    A window would bring a whole group into one task. Here the frame is range-sorted once
    by (group, order), written, and numbered by where each row landed: its index in its
    partition plus the rows of the same group in the partitions before it. The offsets
    are one row per partition and group.
    """
    sorted_once = cut(df.orderBy(F.col(group), *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counted = sorted_once.groupBy(group, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        sorted_once.withColumn("_part", part)
        .join(offsets, [group, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_offset") + 1)
        .drop("_at", "_part", "_first", "_offset")
    )


def first_rows(df: DataFrame, order: list[Column], cap: int | None) -> DataFrame:
    """The first `cap` rows by `order`, or all of them without a cap.

    They are cut by position in a distributed sort, so no task holds `cap` rows.
    """
    if cap is None:
        return df
    numbered = positions(df.withColumn("_all", F.lit(0)), "_all", order, "_position")
    return numbered.where(F.col("_position") <= cap).drop("_all", "_position")


def entry_order() -> list[Column]:
    """Demoted entries last, then best score, company and title; the key settles the rest."""
    return [F.col("demoted"), F.desc("score"), F.lower("company"), F.lower("title"), F.col("job_key")]


def record_appearances(history: DataFrame, entries: DataFrame, day) -> DataFrame:
    """The appearance memory after a digest went out.

    Rows of these jobs on this day are replaced, so sending twice on a day counts once.
    Rows of other jobs shown earlier the same day stay.
    """
    written = entries.select(
        "job_key", F.lit(day).cast("date").alias("digest_date"), "section", F.col("position").cast("bigint"),
        F.col("score").cast("int").alias("score_at_appearance"),
        F.col("content_hash").alias("content_hash_at_appearance"),
    )
    kept = history.join(written.select("job_key", "digest_date"), ["job_key", "digest_date"], "left_anti")
    return kept.unionByName(written)
