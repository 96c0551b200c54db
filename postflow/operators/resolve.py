"""Which postings are the same real opening, and what happens when two openings become one.

A posting belongs to the job with its canonical key, else to the job of the same company
and region whose title is at least 95 alike whatever the word order, else to a new job.
The rule compares postings with jobs in arrival order and is not transitive, so connected
components would be wrong. Instead:

1. titles are reduced to distinct (company, region, sorted words) nodes;
2. the nodes that found a job are the greedy choice in arrival order (a node does unless
   an earlier similar one did): a bounded batch of each company's first undecided titles
   is settled at a time, and its founders then settle every later title like them;
3. each posting takes its best match among stored jobs and earlier founders.

Titles are only ever compared with founders and stored jobs, never all with all, and only
with those that share a segment of letters (`functions/segments.py`): a thousand near-equal
titles of one company cost a thousand comparisons, and a thousand unlike ones hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.segments import entries, entry_keys, probe_keys, probes
from ..functions.similarity import THRESHOLD, indel_similarity, may_match, sorted_ratio, sorted_tokens
from ..functions.text import canonical_key, normalize_company, sha256
from ..functions.titles import normalize_title
from ..session import cut
from .prefilter import POSTING_KEY

# Titles of one company and region whose founders are chosen in one task, at first; every
# round takes `GROWTH` times as many, up to the last value. The result does not depend on them.
FIRST_BATCH = 256
GROWTH = 8
LAST_BATCH = 16_384


# --- similar titles ----------------------------------------------------------------------


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Dealt out to as many tasks as the session shuffles to: few bytes can be much work, which AQE cannot see."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


@lru_cache(maxsize=4)
def _title_columns(context: SparkContext, threshold: int) -> tuple[Column, Column, Column]:
    """What titles are held by, looked up by and compared by: large expressions, built once per context."""
    block, text = F.col("block"), F.col("text")
    return entry_keys(block, text, threshold), probe_keys(block, text, threshold), sorted_ratio(text, F.col("other_text"))


def offered_pairs(titles: DataFrame, targets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, other) of the titles and targets that share a segment; no like pair is missing.

    Keys meet keys: how many a title has follows its length, and only targets that hold the
    same letters at nearly the same place are offered to it.
    """
    entry, probe, _ = _title_columns(titles.sparkSession.sparkContext, threshold)
    held = targets.select(F.col("node").alias("other"), F.explode(entry).alias("key"))
    asked = _dealt(titles.select("node", "block", "text"), "node").select("node", F.explode(probe).alias("key"))
    shared = asked.join(held, "key").where("node <> other").select("node", "other")
    return _dealt(shared, "node", "other").dropDuplicates(["node", "other"])


def similar_titles(titles: DataFrame, targets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (node, other, ratio) of a title and a target at or above `threshold`.

    Both sides hold node, block and text (sorted words); a native edit distance that gives up
    at the pair's budget goes before the ratio. Targets are founders or stored jobs, which are
    unlike each other, so a title meets few that it is like. A title of no words is like no
    other; equal texts are one node.
    """
    one = titles.select("node", "block", "text")
    two = targets.select(F.col("node").alias("other"), F.col("block").alias("other_block"), F.col("text").alias("other_text"))
    pairs = offered_pairs(titles, targets, threshold).join(one, "node").join(two, "other").where("block = other_block")
    budget = F.floor((F.length("text") + F.length("other_text")) * F.lit(100 - threshold) / 100 + 1e-9).cast("int")
    near = pairs.where(F.call_function("levenshtein", F.col("text"), F.col("other_text"), budget) >= 0)
    ratio = _title_columns(titles.sparkSession.sparkContext, threshold)[2]
    return near.select("node", "other", ratio.alias("ratio")).where(F.col("ratio") >= threshold)


# --- who founds a job --------------------------------------------------------------------


class _Founders:
    """The titles of one block that found a job, in arrival order, held by their segments."""

    def __init__(self, threshold: int):
        self.threshold, self.held = threshold, {}

    def takes(self, text: str) -> bool:
        offered = {other for probe in probes(text, self.threshold) for other in self.held.get(probe, ())}
        if any(indel_similarity(text, other) >= self.threshold for other in offered):
            return False
        for entry in entries(text, self.threshold):
            self.held.setdefault(entry, []).append(text)
        return True


def _choose(threshold: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, founders = None, None
        for batch in batches:
            chosen = []
            for node, block, text in zip(*(batch.column(c).to_pylist() for c in ("node", "block", "text"))):
                if founders is None or block != current:
                    current, founders = block, _Founders(threshold)
                if founders.takes(text):
                    chosen.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.string())], names=["node"])

    return work


def job_founders(titles: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The nodes (with block, text) that found a job.

    Greedy in arrival order: a node founds unless an earlier similar founder exists. Each
    round settles the first undecided titles of every block and then all later titles that
    are like one of the new founders. `titles` holds node, block, text and `at`.
    """
    spark = titles.sparkSession
    order = Window.partitionBy("block").orderBy("at")
    undecided = cut(titles.select("node", "block", "text", "at"))
    found, size = [], FIRST_BATCH
    while not undecided.isEmpty():
        # Spark keeps no more than `size` rows per block and task before the shuffle.
        batch = cut(undecided.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size))
        # The rows of a block lie in one task one after the other, `size` at most.
        ordered = _dealt(batch, "block").sortWithinPartitions("block", "place").select("node", "block", "text")
        chosen = ordered.mapInArrow(_choose(threshold), "node string")
        new = cut(batch.select("node", "block", "text").join(chosen, "node", "left_semi"))
        found.append(new)
        rest = cut(undecided.join(batch.select("node"), "node", "left_anti"))
        if rest.isEmpty():
            break
        like = similar_titles(rest, new, threshold).select("node").distinct()
        undecided = cut(rest.join(like, "node", "left_anti"))
        size = min(GROWTH * size, LAST_BATCH)
    if not found:
        return spark.createDataFrame([], "node string, block string, text string")
    return reduce(DataFrame.unionByName, found)


# --- resolution --------------------------------------------------------------------------


@dataclass(frozen=True)
class Resolution:
    """What one batch of postings resolved to.

    assignments: posting key, job_key, action (keep, attach, create, rename, merge), matched_key
    created:     job_key, canonical_key and the founding posting key, of each new job
    renamed:     job_key, canonical_key for jobs whose only posting moved to a new identity
    merges:      kept_from, merged_into (job keys) and `canonical_key`, for `merge_openings`
    """

    assignments: DataFrame
    created: DataFrame
    renamed: DataFrame
    merges: DataFrame


def with_identity(postings: DataFrame, company: str = "company", title: str = "title", region: str = "region") -> DataFrame:
    """Adds block, normalized_title, text (its sorted words) and canonical_key."""
    titled = postings.withColumn("normalized_title", normalize_title(F.col(title), F.col(company)))
    return (
        titled.withColumn("block", F.concat_ws("\x1f", normalize_company(F.col(company)), F.col(region)))
        .withColumn("text", sorted_tokens(F.col("normalized_title")))
        .withColumn("canonical_key", canonical_key(F.col(company), F.col("normalized_title"), F.col(region)))
    )


def _node(block: str = "block", text: str = "text") -> Column:
    return sha256(F.col(block), F.col(text))


def resolve_openings(postings: DataFrame, jobs: DataFrame, threshold: int = THRESHOLD) -> Resolution:
    """Assigns every posting to a job.

    `postings`: posting key, job_key (null when new), first_seen, company, title, region.
    `jobs`: job_key, canonical_key, company, title, region, first_seen.

    Companies are told apart by normalised name, as the canonical key does. Arrival order
    is (first_seen, posting key). A posting that moved away from its job is matched like a
    new one; its own job is never a candidate because it would have kept it.
    """
    arriving = cut(with_identity(postings).select(
        *POSTING_KEY, "job_key", "block", "text", "normalized_title", "canonical_key",
        F.struct("first_seen", *POSTING_KEY).alias("at"),
    ))
    stored = cut(with_identity(jobs.withColumnRenamed("canonical_key", "_key")).select(
        "job_key", "block", "text", F.col("_key").alias("canonical_key"), F.struct("first_seen", "job_key").alias("job_at"),
    ))

    # A posting keeps its job while the key holds or the title still reads the same.
    mine = arriving.where("job_key IS NOT NULL").join(
        stored.select("job_key", F.col("block").alias("job_block"), F.col("text").alias("job_text"),
                      F.col("canonical_key").alias("job_canonical")), "job_key")
    same_key = mine.where("canonical_key = job_canonical")
    other_key = mine.where("NOT (canonical_key <=> job_canonical) AND block = job_block")
    same_title = other_key.where(may_match(F.col("text"), F.col("job_text"), threshold)).where(
        sorted_ratio(F.col("text"), F.col("job_text")) >= threshold)
    kept = same_key.select(*POSTING_KEY, "job_key").unionByName(same_title.select(*POSTING_KEY, "job_key"))
    moving = cut(arriving.join(kept, POSTING_KEY, "left_anti"))

    # Distinct titles, each with its first posting.
    nodes = cut(
        moving.groupBy("block", "text")
        .agg(F.min(F.struct("at", "canonical_key", "job_key")).alias("first"))
        .select(_node().alias("node"), "block", "text", F.col("first.at").alias("at"),
                F.col("first.canonical_key").alias("canonical_key"), F.col("first.job_key").alias("job_key"))
    )
    job_titles = stored.groupBy("block", "text").agg(F.min("job_at").alias("job_at")).withColumn("title_node", _node())

    # Stored jobs a title could join: by key, by the same words, by similar words.
    by_words = nodes.join(job_titles.select("block", "text", "job_at"), ["block", "text"]).select(
        "node", "job_at", F.lit(100.0).alias("ratio"))
    by_similarity = similar_titles(nodes, job_titles.select(F.col("title_node").alias("node"), "block", "text"), threshold).join(
        job_titles.select(F.col("title_node").alias("other"), "job_at"), "other").select("node", "job_at", "ratio")
    job_matches = by_words.unionByName(by_similarity)
    by_key = moving.join(
        stored.groupBy("canonical_key").agg(F.min("job_at").alias("job_at")), "canonical_key"
    ).select(*POSTING_KEY, "job_at")
    first_by_key = nodes.join(by_key.select(F.struct(*POSTING_KEY).alias("_p"), "job_at"),
                              F.struct(*[F.col(f"at.{c}").alias(c) for c in POSTING_KEY]) == F.col("_p"), "left_semi")

    settled_by_jobs = cut(job_matches.select("node").unionByName(first_by_key.select("node")).distinct())
    free = nodes.join(settled_by_jobs, "node", "left_anti")
    founders = cut(free.join(job_founders(free, threshold).select("node"), "node", "left_semi").select(
        "node", "at", "canonical_key",
        F.coalesce("job_key", sha256(F.col("at.source"), F.col("at.source_job_id"))).alias("founder_job"),
    ))

    # Every posting's candidates, best first: same key, then most alike, then oldest.
    titled = moving.withColumn("node", _node())
    own_founder = founders.select("node", F.col("node").alias("other"), F.lit(100.0).alias("ratio"))
    other_founders = similar_titles(nodes, founders.join(nodes.select("node", "block", "text"), "node"), threshold)
    near = own_founder.unionByName(other_founders.select("node", "other", "ratio")).join(
        founders.select(F.col("node").alias("other"), F.col("at").alias("founded_at"), "founder_job"), "other")
    keyed = founders.select("canonical_key", F.col("at").alias("founded_at"), "founder_job")

    def choice(exact: bool, ratio, new: bool, order: Column, job: Column) -> Column:
        # New jobs come after every stored one among equals, in founding order.
        return F.struct(
            F.lit(0 if exact else 1).alias("exact"), (-ratio).alias("ratio"), F.lit(1 if new else 0).alias("new"),
            order["first_seen"].alias("since"), job.alias("job"),
        )

    me = [*POSTING_KEY, "at"]
    stored_key = by_key.join(moving.select(*me), POSTING_KEY).select(
        *me, choice(True, F.lit(100.0), False, F.col("job_at"), F.col("job_at.job_key")).alias("c"))
    stored_like = titled.select(*me, "node").join(job_matches, "node").select(
        *me, choice(False, F.col("ratio"), False, F.col("job_at"), F.col("job_at.job_key")).alias("c"))
    founder_key = moving.select(*me, "canonical_key").join(keyed, "canonical_key").where("founded_at <= at").select(
        *me, choice(True, F.lit(100.0), True, F.col("founded_at"), F.col("founder_job")).alias("c"))
    founder_like = titled.select(*me, "node").join(near, "node").where("founded_at <= at").select(
        *me, choice(False, F.col("ratio"), True, F.col("founded_at"), F.col("founder_job")).alias("c"))
    options = reduce(DataFrame.unionByName, [stored_key, stored_like, founder_key, founder_like])
    best = options.groupBy(*POSTING_KEY).agg(F.min("c").alias("c")).select(
        *POSTING_KEY, F.col("c.job").alias("matched"))

    founding = founders.select(F.col("at.source").alias("source"), F.col("at.source_job_id").alias("source_job_id"), F.lit(True).alias("_founds"))
    decided = (
        moving.select(*POSTING_KEY, "job_key", "canonical_key").join(best, POSTING_KEY)
        .join(founding, POSTING_KEY, "left")
    )
    action = (
        F.when(F.col("job_key").isNull() & F.col("_founds"), F.lit("create"))
        .when(F.col("job_key").isNull(), F.lit("attach"))
        .when(F.col("matched") == F.col("job_key"), F.lit("rename"))
        .otherwise(F.lit("merge"))
    )
    assigned = cut(
        decided.withColumn("action", action)
        .select(*POSTING_KEY, F.coalesce("job_key", "matched").alias("job_key"), "action", "matched", "canonical_key")
        .unionByName(
            kept.select(*POSTING_KEY, "job_key", F.lit("keep").alias("action"), F.col("job_key").alias("matched"),
                        F.lit(None).cast("string").alias("canonical_key")))
    )
    created = assigned.where("action = 'create'").select("job_key", "canonical_key", *POSTING_KEY)
    # Of several postings that moved, the one that arrived last names the job.
    renamed = assigned.where("action = 'rename'").join(moving.select(*POSTING_KEY, "at"), POSTING_KEY).groupBy("job_key").agg(
        F.max_by("canonical_key", "at").alias("canonical_key"))
    merges = assigned.where("action = 'merge'").select(
        F.col("job_key").alias("kept_from"), F.col("matched").alias("merged_into"), "canonical_key", *POSTING_KEY)
    return Resolution(assigned.drop("matched"), created, renamed, merges)


# --- merging -----------------------------------------------------------------------------


def survivor_rank(has_application: Column, has_score: Column, first_seen: Column, job_key: Column) -> Column:
    """The smallest survives: applied to, else scored, else older, else the smaller key."""
    return F.struct(
        (~F.coalesce(has_application, F.lit(False))).alias("not_applied"),
        (~F.coalesce(has_score, F.lit(False))).alias("not_scored"),
        first_seen.alias("first_seen"),
        job_key.alias("job_key"),
    )


def ranked_jobs(jobs: DataFrame, applications: DataFrame, scored_jobs: DataFrame) -> DataFrame:
    """(job_key, rank) of every job."""
    applied = applications.select("job_key", F.lit(True).alias("_applied")).distinct()
    scored = scored_jobs.select("job_key", F.lit(True).alias("_scored")).distinct()
    return jobs.join(applied, "job_key", "left").join(scored, "job_key", "left").select(
        "job_key", survivor_rank(F.col("_applied"), F.col("_scored"), F.col("first_seen"), F.col("job_key")).alias("rank"))


def survivors(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(job_key, survivor) for every job named in `pairs` (kept_from, merged_into).

    Jobs linked by pairs become one, under the first of them by rank. A job that was
    applied to is never given up, so where several are linked each stays and the others
    follow the first of them they can reach. Labels spread along the pairs until nothing
    changes, and jump to their label's label on the way, so long chains settle quickly.
    """
    links = pairs.select(F.col("kept_from").alias("a"), F.col("merged_into").alias("b")).where("a <> b")
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named = links.select(F.col("a").alias("job_key")).distinct()
    labels = cut(ranks.join(named, "job_key", "left_semi").select(
        "job_key", "rank", F.col("rank").alias("label")))
    while True:
        spread = links.join(labels.select(F.col("job_key").alias("b"), F.col("label").alias("offer")), "b").select(
            F.col("a").alias("job_key"), "offer")
        jump = labels.select("job_key", F.col("label.job_key").alias("over")).join(
            labels.select(F.col("job_key").alias("over"), F.col("label").alias("offer")), "over").select("job_key", "offer")
        best = spread.unionByName(jump).groupBy("job_key").agg(F.min("offer").alias("offer"))
        better = F.col("rank.not_applied") & (F.col("offer") < F.col("label"))
        moved = cut(
            labels.join(best, "job_key", "left")
            .withColumn("_moves", F.coalesce(better, F.lit(False)))
            .select("job_key", "rank", F.when(F.col("_moves"), F.col("offer")).otherwise(F.col("label")).alias("label"), "_moves")
        )
        labels = moved.drop("_moves")
        if moved.where("_moves").isEmpty():
            return labels.select("job_key", F.col("label.job_key").alias("survivor"))


@dataclass(frozen=True)
class Merged:
    """The tables after a merge."""

    jobs: DataFrame
    postings: DataFrame
    applications: DataFrame
    appearances: DataFrame


def merge_openings(
    plan: DataFrame, jobs: DataFrame, postings: DataFrame, applications: DataFrame, appearances: DataFrame
) -> Merged:
    """Merges jobs by `survivors`: postings, applications and appearances move to the survivor.

    Scores belong to postings and travel with them. Where the survivor and a merged job
    were shown on the same day, the survivor's row stays. The survivor takes over a missing
    primary posting and the earliest `posted_at`.
    """
    plan = plan.where("job_key <> survivor")

    def follow(df: DataFrame) -> DataFrame:
        return (
            df.join(plan, "job_key", "left")
            .withColumn("_moved", F.col("survivor").isNotNull())
            .withColumn("job_key", F.coalesce("survivor", "job_key"))
            .drop("survivor")
        )

    day = ["job_key", "digest_date"]
    columns = [c for c in appearances.columns if c not in day]
    # At most one row per merged job and day: a bounded choice, combined before the shuffle.
    shown = (
        follow(appearances).groupBy(*day)
        .agg(F.min_by(F.struct(*columns), F.struct("_moved", *[c for c in columns if c in ("section", "position")])).alias("_row"))
        .select(*day, "_row.*").select(*appearances.columns)
    )
    given = (
        jobs.join(plan, "job_key")
        .groupBy("survivor")
        .agg(
            F.min("posted_at").alias("_posted_at"),
            F.min(F.when(F.col("primary_source_job_id").isNotNull(),
                         F.struct("first_seen", "job_key", "primary_source", "primary_source_job_id"))).alias("_primary"),
        )
        .withColumnRenamed("survivor", "job_key")
    )
    orphan = F.col("primary_source_job_id").isNull()
    remaining = (
        jobs.join(plan.select("job_key"), "job_key", "left_anti")
        .join(given, "job_key", "left")
        .withColumn("posted_at", F.least("posted_at", "_posted_at"))
        .withColumn("primary_source", F.when(orphan, F.col("_primary.primary_source")).otherwise(F.col("primary_source")))
        .withColumn("primary_source_job_id", F.when(orphan, F.col("_primary.primary_source_job_id"))
                    .otherwise(F.col("primary_source_job_id")))
        .select(*jobs.columns)
    )
    return Merged(
        remaining,
        follow(postings).select(*postings.columns),
        follow(applications).select(*applications.columns),
        shown,
    )


def retaken_keys(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs with the canonical key each wants (job_key, canonical_key), where it is free.

    A key another job holds stays with that job. Two jobs wanting one key: the older gets it.
    """
    asked = jobs.join(wanted.withColumnRenamed("canonical_key", "_wanted"), "job_key")
    free = asked.join(jobs.select(F.col("canonical_key").alias("_wanted")), "_wanted", "left_anti")
    order = Window.partitionBy("_wanted").orderBy("first_seen", "job_key")
    granted = free.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("job_key", "_wanted")
    return (
        jobs.join(granted, "job_key", "left")
        .withColumn("canonical_key", F.coalesce("_wanted", "canonical_key"))
        .select(*jobs.columns)
    )
