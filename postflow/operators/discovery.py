"""From noisy sightings to a ranked review queue of companies, and the decisions on it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scans import last_before
from ..functions.text import board_api, board_page, normalize_company, slug_for, slug_variants, strip, token_from_url
from ..schemas import TABLES, struct_of
from ..session import cut
from .prefilter import POSTING_KEY
from .ranking import positions

# How many roles and sightings stand beside a candidate in the review queue.
# All roles are rows of `role_mentions`; all sightings are rows of the postings table.
MAX_ROLES = 12
MAX_EVIDENCE = 30
PROBE_ORDER = ["greenhouse", "lever", "ashby"]


# --- what is watched ---------------------------------------------------------------------


def watched_names(*lists: DataFrame) -> DataFrame:
    """(name_key, slug) under which companies are watched: by name and by slug, earlier lists first."""
    parts = [
        df.select(
            "slug", F.lit(i).alias("rank"),
            F.explode(F.array(normalize_company(F.col("name")), normalize_company(F.col("slug")))).alias("name_key"),
        )
        for i, df in enumerate(lists)
    ]
    return (
        reduce(DataFrame.unionByName, parts).where("name_key <> ''")
        .groupBy("name_key").agg(F.min_by("slug", F.struct("rank", "slug")).alias("slug"))
    )


def watched_boards(*lists: DataFrame) -> DataFrame:
    """(ats_type, ats_token, slug) of the boards being watched, earlier lists first."""
    parts = [
        df.select("slug", F.lit(i).alias("rank"), "ats_type",
                  F.lower(F.try_element_at("ats_config", F.lit("token"))).alias("ats_token"))
        for i, df in enumerate(lists)
    ]
    return (
        reduce(DataFrame.unionByName, parts).where("ats_token <> ''")
        .groupBy("ats_type", "ats_token").agg(F.min_by("slug", F.struct("rank", "slug")).alias("slug"))
    )


def watched_as(df: DataFrame, names: DataFrame, boards: DataFrame) -> DataFrame:
    """`df` (name_key, ats_type, ats_token) with `watched_slug`, by name first and then by board.

    Two equi-joins; a single `name OR board` condition would compare every pair.
    """
    return (
        df.join(names.withColumnRenamed("slug", "_by_name"), "name_key", "left")
        .join(boards.withColumnRenamed("slug", "_by_board"), ["ats_type", "ats_token"], "left")
        .withColumn("watched_slug", F.coalesce("_by_name", "_by_board"))
        .drop("_by_name", "_by_board")
    )


def approve_watched(candidates: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """Pending candidates the watchlist now lists become approved."""
    marked = watched_as(candidates, watched_names(watchlist), watched_boards(watchlist))
    hit = (F.col("status") == "pending") & F.col("watched_slug").isNotNull()
    return marked.select(*[
        F.when(hit, F.lit("approved")).otherwise(F.col(c)).alias(c) if c == "status"
        else F.when(hit, now.cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "decided_at"
        else F.when(hit, F.col("watched_slug")).otherwise(F.col(c)).alias(c) if c == "slug"
        else F.col(c)
        for c in candidates.columns
    ])


# --- boards ------------------------------------------------------------------------------


def board_choices(names: DataFrame, boards: DataFrame, key: str = "name_key") -> DataFrame:
    """Every board of the directory a company's spellings reach.

    `names`: key, name, careers_url. `boards`: ats_type, ats_token, board_jobs, a directory of
    known boards. A careers link that names a board adds its token ahead of the spellings.
    Each name yields a fixed small number of spellings, matched by an equi-join.
    """
    hint = token_from_url(F.col("careers_url"))
    tokens = F.array_distinct(F.concat(
        F.filter(F.array(hint["token"]), lambda t: t.isNotNull()), slug_variants(F.col("name"))))
    tried = names.select(key, hint.alias("hint"), F.posexplode(tokens).alias("position", "ats_token"))
    place = F.coalesce(*[F.when(F.col("ats_type") == a, F.lit(i)) for i, a in enumerate(PROBE_ORDER)],
                       F.lit(len(PROBE_ORDER)))
    return tried.join(boards.select("ats_type", "ats_token", "board_jobs"), "ats_token").withColumn(
        "hinted", F.coalesce((F.col("hint.ats") == F.col("ats_type")) & (F.col("hint.token") == F.col("ats_token")), F.lit(False))
    ).withColumn("probe", F.struct("position", place.alias("ats")))


def lookup_boards(names: DataFrame, boards: DataFrame, key: str = "name_key") -> DataFrame:
    """The board to watch per name: the hinted one, else the busiest; none without postings."""
    best = F.min_by(
        F.struct("ats_type", "ats_token", "board_jobs"),
        F.struct((~F.col("hinted")).alias("h"), F.when(F.col("hinted"), 0).otherwise(-F.col("board_jobs")).alias("j"), "probe"),
    )
    return (
        board_choices(names, boards, key).where("board_jobs > 0")
        .groupBy(key).agg(best.alias("b")).select(key, "b.*")
        .withColumn("board_url", board_api(F.col("ats_type"), F.col("ats_token")))
    )


# --- sightings ---------------------------------------------------------------------------


def new_sightings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose key was never stored. What was seen once is never processed again."""
    return postings.join(seen.select(*POSTING_KEY), POSTING_KEY, "left_anti")


def touch_seen(seen: DataFrame, postings: DataFrame, now: Column) -> DataFrame:
    """Stored sightings with `last_seen` moved for those listed again."""
    again = postings.select(*POSTING_KEY, F.lit(True).alias("_again")).distinct()
    return seen.join(again, POSTING_KEY, "left").withColumn(
        "last_seen", F.when(F.col("_again"), now.cast("timestamp")).otherwise(F.col("last_seen"))).drop("_again")


@dataclass(frozen=True)
class Attached:
    """candidates after a run, and what became of every sighting (`outcome`, `candidate_key`)."""

    candidates: DataFrame
    outcomes: DataFrame


def attach_candidates(
    sightings: DataFrame, candidates: DataFrame, names: DataFrame, watched: DataFrame,
    boards: DataFrame, now: Column, reprobe_after_days: int,
) -> Attached:
    """Puts named sightings on the companies they speak of.

    `sightings`: posting key, `name`, `roles`, `careers_url`, `title`, `url`, `position` (their
    order). `names` and `watched` come from `watched_names` and `watched_boards`; `boards` is
    the directory. A name is looked up once per run. Watched and approved companies take
    nothing; rejected ones keep counting; the rest are found by name, then by board, or are new.
    """
    moment = now.cast("timestamp")
    told = sightings.withColumn("name", strip(F.col("name"))).withColumn(
        "name_key", normalize_company(F.coalesce("name", F.lit(""))))
    told = told.withColumn("_order", F.struct("position", *POSTING_KEY))
    spoken = told.where("name_key <> ''").groupBy("name_key").agg(
        F.min_by("name", "_order").alias("name"),
        F.min("_order").alias("first_order"),
        F.min_by("careers_url", F.when(F.col("careers_url") != "", F.col("_order"))).alias("careers_url"),
    )
    known = candidates.select(
        "name_key", F.col("status").alias("known_status"), F.col("ats_type").alias("known_ats"), "probed_at")
    placed = spoken.join(known, "name_key", "left").join(
        names.select("name_key", F.col("slug").alias("watched_name")), "name_key", "left")
    listed = F.col("watched_name").isNotNull() | F.coalesce(F.col("known_status") == "approved", F.lit(False))
    stale = F.col("probed_at").isNull() | (
        F.unix_micros(moment) - F.unix_micros("probed_at") >= reprobe_after_days * 86_400_000_000)
    probe = ~listed & (F.col("known_status").isNull() | (F.col("known_ats").isNull() & stale))
    placed = cut(placed.withColumn("listed", listed).withColumn("probes", probe))
    found = lookup_boards(placed.where("probes").select("name_key", "name", "careers_url"), boards)
    placed = placed.join(found, "name_key", "left").join(
        watched.select("ats_type", "ats_token", F.col("slug").alias("watched_board")), ["ats_type", "ats_token"], "left")

    # A board another candidate already has makes its name a second spelling of that one.
    holders = candidates.where("ats_type IS NOT NULL AND ats_token IS NOT NULL").groupBy("ats_type", "ats_token").agg(
        F.min_by("name_key", F.struct("first_seen", "name_key")).alias("holder"))
    fresh = F.col("known_status").isNull() & ~F.col("listed")
    placed = placed.join(holders, ["ats_type", "ats_token"], "left")
    newcomers = placed.where(fresh & F.col("ats_type").isNotNull()).groupBy("ats_type", "ats_token").agg(
        F.min_by("name_key", "first_order").alias("first_name"))
    placed = placed.join(newcomers, ["ats_type", "ats_token"], "left")
    board_watched = fresh & F.col("watched_board").isNotNull()
    placed = cut(
        placed.withColumn(
            "candidate_key",
            F.when(F.col("listed") | board_watched, F.lit(None).cast("string"))
            .when(F.col("known_status").isNotNull(), F.col("name_key"))
            .otherwise(F.coalesce("holder", "first_name", "name_key")),
        )
    )

    attributed = told.join(placed.select("name_key", "candidate_key", "first_order"), "name_key", "left")
    is_new = attributed.join(candidates.select(F.col("name_key").alias("candidate_key"), F.lit(True).alias("_stored")),
                             "candidate_key", "left")
    creates = F.col("_stored").isNull() & (F.col("candidate_key") == F.col("name_key")) & (F.col("_order") == F.col("first_order"))
    outcome = (
        F.when(F.col("name_key") == "", F.lit("unattributed"))
        .when(F.col("candidate_key").isNull(), F.lit("already_watched"))
        .when(creates, F.lit("new_candidate"))
        .otherwise(F.lit("seen_again"))
    )
    outcomes = cut(is_new.withColumn("outcome", outcome).drop("_stored", "first_order"))
    taken = outcomes.where("candidate_key IS NOT NULL")

    # The board each candidate ends up with: the one just found, for names that looked.
    boarded = placed.where("probes AND candidate_key IS NOT NULL").groupBy("candidate_key").agg(
        F.min_by(F.struct("ats_type", "ats_token", "board_url", "board_jobs"),
                 F.when(F.col("ats_type").isNotNull(), F.col("first_order"))).alias("_board"))
    first_names = placed.where("candidate_key = name_key").select("candidate_key", F.col("name").alias("_name"))
    rolled = roll_up(taken, moment)
    grown = (
        candidates.withColumn("candidate_key", F.col("name_key"))
        .join(rolled, "candidate_key", "full_outer")
        .join(boarded, "candidate_key", "left").join(first_names, "candidate_key", "left")
    )
    touched = F.col("_count").isNotNull()
    merged = grown.select(
        F.coalesce("name", "_name").alias("name"), F.col("candidate_key").alias("name_key"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("_board.ats_type", "ats_type").alias("ats_type"),
        F.coalesce("_board.ats_token", "ats_token").alias("ats_token"),
        F.coalesce("_board.board_url", "board_url").alias("board_url"),
        F.coalesce("_board.board_jobs", "board_jobs").alias("board_jobs"),
        "probed_at",
        F.coalesce(F.nullif("careers_url", F.lit("")), "_careers_url").alias("careers_url"),
        F.col("roles"), F.col("evidence"),
        (F.coalesce("sightings", F.lit(0)) + F.coalesce("_count", F.lit(0))).cast("bigint").alias("sightings"),
        F.when(F.col("first_seen").isNull(), moment).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(touched, moment).otherwise(F.col("last_seen")).alias("last_seen"),
        "decided_at", "slug", "_roles", "_evidence",
    )
    probed = placed.where("probes AND candidate_key IS NOT NULL").select(
        F.col("candidate_key").alias("name_key"), F.lit(True).alias("_probed")).distinct()
    merged = merged.join(probed, "name_key", "left").withColumn(
        "probed_at", F.when(F.col("_probed"), moment).otherwise(F.col("probed_at")))
    empty_roles, empty_evidence = (F.array().cast(struct_of(TABLES["candidate_companies"])[c].dataType) for c in ("roles", "evidence"))
    both_roles = F.array_distinct(F.concat(F.coalesce("roles", empty_roles), F.coalesce("_roles", empty_roles)))
    both_evidence = F.concat(F.coalesce("evidence", empty_evidence), F.coalesce("_evidence", empty_evidence))
    # The last 30 in order; `slice` from the end needs at least that many elements.
    kept = F.slice(both_evidence, F.greatest(F.size(both_evidence) - MAX_EVIDENCE + 1, F.lit(1)), MAX_EVIDENCE)
    columns = struct_of(TABLES["candidate_companies"]).fieldNames()
    return Attached(
        merged.withColumn("roles", F.slice(both_roles, 1, MAX_ROLES)).withColumn("evidence", kept).select(*columns),
        outcomes,
    )


def role_mentions(sightings: DataFrame) -> DataFrame:
    """candidate_key, role, sightings, at: every role of every candidate, with its first mention."""
    return (
        sightings.select("candidate_key", "_order", F.posexplode("roles").alias("_n", "role"))
        .withColumn("role", strip(F.col("role"))).where("role <> ''")
        .groupBy("candidate_key", "role")
        .agg(F.count(F.lit(1)).alias("sightings"), F.min(F.struct("_order", "_n")).alias("at"))
    )


def roll_up(sightings: DataFrame, moment: Column) -> DataFrame:
    """Sightings per candidate: how many, the first roles, the last evidence, a careers link.

    `sightings` has candidate_key, `_order`, roles, careers_url, title, url and the posting key.
    Roles are reduced to their first mention, and evidence to its last rows, on the map side
    (the filters on the row numbers), so a company seen everywhere stays a small group.
    """
    totals = sightings.groupBy("candidate_key").agg(
        F.count(F.lit(1)).alias("_count"),
        F.min_by("careers_url", F.when(F.col("careers_url") != "", F.col("_order"))).alias("_careers_url"),
    )
    mentions = role_mentions(sightings).select("candidate_key", F.col("role").alias("_role"), F.col("at").alias("_at"))
    first = Window.partitionBy("candidate_key").orderBy("_at")
    roles = (
        mentions.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= MAX_ROLES)
        .groupBy("candidate_key").agg(F.array_sort(F.collect_list(F.struct("_rank", "_role"))).alias("_roles"))
        .select("candidate_key", F.transform("_roles", lambda r: r["_role"]).alias("_roles"))
    )
    last = Window.partitionBy("candidate_key").orderBy(F.desc("_order"))
    shown = F.struct("source", "source_job_id", F.col("title"), "url", moment.alias("seen"))
    evidence = (
        sightings.select("candidate_key", "_order", shown.alias("_shown"))
        .withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= MAX_EVIDENCE)
        .groupBy("candidate_key").agg(F.array_sort(F.collect_list(F.struct("_order", "_shown"))).alias("_evidence"))
        .select("candidate_key", F.transform("_evidence", lambda r: r["_shown"]).alias("_evidence"))
    )
    return totals.join(roles, "candidate_key", "left").join(evidence, "candidate_key", "left")


# --- the queue ---------------------------------------------------------------------------


def queue_columns(candidates: DataFrame) -> DataFrame:
    """Candidates flattened for a reviewer: slug, page, distinct sources, last two titled sightings."""
    empty = F.array().cast(struct_of(TABLES["candidate_companies"])["evidence"].dataType)
    evidence = F.coalesce("evidence", empty)
    sources = F.filter(F.transform(evidence, lambda e: e["source"]), lambda s: s != "")
    last_two = F.slice(evidence, F.greatest(F.size(evidence) - 1, F.lit(1)), 2)
    return (
        candidates.withColumn("proposed_slug", slug_for(F.col("name")))
        .withColumn("has_board", (F.col("ats_type") != "") & (F.col("ats_token") != "") & F.col("ats_type").isNotNull())
        .withColumn("has_board", F.coalesce("has_board", F.lit(False)))
        .withColumn("page_url", F.coalesce(F.nullif("careers_url", F.lit("")), board_page(F.col("ats_type"), F.col("ats_token"))))
        .withColumn("sources", F.array_sort(F.array_distinct(sources)))
        .withColumn("seen", F.transform(
            F.filter(last_two, lambda e: e["title"] != ""), lambda e: F.struct(e["title"].alias("title"), e["url"].alias("url"))))
    )


def queue_order() -> list[Column]:
    """Companies with a board first, then the most seen, the busiest, by name."""
    return [F.col("ats_type").isNull(), F.desc("sightings"), F.desc(F.coalesce("board_jobs", F.lit(0))),
            F.lower("name"), F.col("name_key")]


def review_queue(candidates: DataFrame, watchlist: DataFrame, now: Column) -> DataFrame:
    """Pending candidates with their position in review order, without those the watchlist has meanwhile."""
    current = approve_watched(candidates, watchlist, now)
    queued = queue_columns(current.where("status = 'pending'"))
    return positions(queued.withColumn("_all", F.lit(0)), "_all", queue_order()).drop("_all")


def rejected(candidates: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the rejections with their position, latest first, how many there are); a limit is the caller's."""
    silenced = candidates.where("status = 'rejected'")
    order = [F.desc("decided_at"), F.desc("name_key")]
    newest = positions(queue_columns(silenced).withColumn("_all", F.lit(0)), "_all", order).drop("_all")
    if limit is not None:
        newest = newest.where(F.col("position") <= limit)
    return newest, silenced.agg(F.count(F.lit(1)).alias("rejected"))


@dataclass(frozen=True)
class Decided:
    """The tables after a batch of decisions, and what each decision did."""

    candidates: DataFrame
    watchlist: DataFrame
    outcomes: DataFrame


def _greedy(claims: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Claims granted in `seq` order, at most one for every value of each group of columns.

    In rounds: a claim that is first in all its groups is granted and removes its rivals.
    """
    granted = None
    left = cut(claims)
    while not left.isEmpty():
        first = left
        for i, columns in enumerate(groups):
            lead = left.groupBy(*columns).agg(F.min("seq").alias(f"_lead{i}"))
            first = first.join(lead, columns)
        first = cut(first.where(reduce(lambda a, b: a & b, [F.col("seq") == F.col(f"_lead{i}") for i in range(len(groups))]))
                    .select(*claims.columns))
        granted = first if granted is None else granted.unionByName(first)
        for columns in groups:
            left = left.join(first.select(*columns), columns, "left_anti")
        left = cut(left)
    return granted if granted is not None else left


def apply_decisions(candidates: DataFrame, decisions: DataFrame, watchlist: DataFrame) -> Decided:
    """Approvals, rejections and their undoing, in `seq` order.

    `decisions`: name_key, decision (approve, reject, unreject), slug, name, tier, seq,
    decided_at; slug, name and tier may be null. An approval needs a board, a slug the
    watchlist does not have and a board it does not watch. Approved is final.
    """
    entry = watchlist.select("slug", "ats_type", F.lower(F.try_element_at("ats_config", F.lit("token"))).alias("ats_token"))
    asked = decisions.join(
        candidates.select("name_key", F.col("name").alias("candidate_name"), "status", "ats_type", "ats_token"),
        "name_key", "left",
    )
    asked = (
        asked.withColumn("display", strip(F.coalesce(F.nullif("name", F.lit("")), F.col("candidate_name"))))
        .withColumn("chosen", F.coalesce(F.nullif("slug", F.lit("")), slug_for(F.col("display"))))
        .withColumn("seq", F.col("seq").cast("bigint"))
    )
    taken_slugs = entry.select(F.col("slug").alias("chosen"), F.lit(True).alias("slug_taken")).distinct()
    taken_boards = entry.where("ats_token <> ''").select("ats_type", "ats_token", F.lit(True).alias("board_taken")).distinct()
    checked = cut(
        asked.join(taken_slugs, "chosen", "left").join(taken_boards, ["ats_type", "ats_token"], "left")
    )
    boardless = F.coalesce((F.col("ats_type") == "") | (F.col("ats_token") == ""), F.lit(False)) | F.col("ats_type").isNull() | F.col("ats_token").isNull()
    feasible = checked.where((F.col("decision") == "approve") & F.col("status").isin("pending", "rejected")).where(
        ~boardless & F.col("slug_taken").isNull() & F.col("board_taken").isNull() & F.col("chosen").isNotNull())
    granted = cut(_greedy(
        feasible.select("name_key", "chosen", "ats_type", "ats_token", "seq", "display", "tier", "decided_at"),
        [["name_key"], ["chosen"], ["ats_type", "ats_token"]],
    ))
    won = granted.select("name_key", F.col("seq").alias("granted_seq"))
    # Slugs and boards granted in this batch block the later decisions that wanted them.
    slug_won = granted.select("chosen", F.col("seq").alias("slug_seq"))
    board_won = granted.select("ats_type", "ats_token", F.col("seq").alias("board_seq"))
    toggle = F.when(F.col("decision").isin("reject", "unreject"), F.col("decision"))
    seen = last_before(checked, "name_key", "seq", toggle, "last_toggle")
    seen = seen.join(won, "name_key", "left").join(slug_won, "chosen", "left").join(board_won, ["ats_type", "ats_token"], "left")
    was_approved = (F.col("status") == "approved") | F.coalesce(F.col("granted_seq") < F.col("seq"), F.lit(False))
    is_rejected = F.coalesce(F.col("last_toggle") == "reject", F.col("status") == "rejected")
    decision = F.col("decision")
    reason = (
        F.when(F.col("candidate_name").isNull(), F.lit("refused: no such candidate"))
        .when(was_approved, F.lit("refused: already in the watchlist"))
        .when((decision == "approve") & (F.col("granted_seq") == F.col("seq")), F.lit("approved"))
        .when((decision == "approve") & boardless, F.lit("refused: no board"))
        .when((decision == "approve") & F.col("chosen").isNull(), F.lit("refused: no slug"))
        .when((decision == "approve") & (F.col("slug_taken").isNotNull() | F.coalesce(F.col("slug_seq") < F.col("seq"), F.lit(False))),
              F.lit("refused: slug taken"))
        .when(decision == "approve", F.lit("refused: board already watched"))
        .when(decision == "reject", F.lit("rejected"))
        .when((decision == "unreject") & is_rejected, F.lit("pending"))
        .when(decision == "unreject", F.lit("refused: not rejected"))
        .otherwise(F.lit("refused: unknown decision"))
    )
    outcomes = cut(seen.withColumn("reason", reason).withColumn("changed", ~F.startswith("reason", F.lit("refused")))
                   .select("name_key", "seq", "decision", "changed", "reason", "chosen", "decided_at"))
    last = outcomes.where("changed").groupBy("name_key").agg(
        F.max_by(F.struct("reason", "decided_at", "chosen"), "seq").alias("_last"))
    after = candidates.join(last, "name_key", "left")
    changed = {
        "status": F.coalesce("_last.reason", "status"),
        "decided_at": F.when(F.col("_last").isNull(), F.col("decided_at")).when(
            F.col("_last.reason") != "pending", F.col("_last.decided_at")),
        "slug": F.when(F.col("_last.reason") == "approved", F.col("_last.chosen")).otherwise(F.col("slug")),
    }
    grown = watchlist.unionByName(
        granted.select(
            F.col("chosen").alias("slug"), F.col("display").alias("name"), "ats_type",
            F.create_map(F.lit("token"), F.col("ats_token")).alias("ats_config"),
            F.coalesce("tier", F.lit("discovered")).alias("tier"), F.lit(True).alias("active"),
        ),
        allowMissingColumns=True,
    )
    return Decided(
        after.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in candidates.columns]),
        grown,
        outcomes.drop("chosen", "decided_at"),
    )


def discovery_report(
    fetch_runs: DataFrame, matched: DataFrame, fresh: DataFrame, extracted: DataFrame, capped: DataFrame,
    outcomes: DataFrame, boards_found: DataFrame,
) -> DataFrame:
    """Discovery counters per source; the totals are the row whose source is null.

    Each frame has a `source` column and one row per case; `extracted` also has `error`.
    """
    def tally(df: DataFrame, name) -> DataFrame:
        counter = F.lit(name) if isinstance(name, str) else name
        return df.select("source", counter.alias("counter"), F.lit(1).cast("bigint").alias("n"))

    rows = [
        fetch_runs.select("source", F.lit("fetched").alias("counter"), F.coalesce("item_count", F.lit(0)).cast("bigint").alias("n")),
        tally(fetch_runs.where("status = 'failed'"), "failed"),
        tally(matched, "matched"),
        tally(fresh, "new_sightings"),
        tally(extracted, F.when(F.col("error").isNull(), F.lit("extracted")).otherwise(F.lit("extraction_failed"))),
        tally(capped, "capped"),
        tally(outcomes, F.col("outcome")),
        tally(boards_found, "boards_found"),
    ]
    counters = ["fetched", "failed", "matched", "new_sightings", "extracted", "extraction_failed", "capped",
                "unattributed", "new_candidate", "seen_again", "already_watched", "boards_found"]
    summed = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in counters]
    return (
        reduce(DataFrame.unionByName, rows).rollup("source").agg(*summed)
        .withColumn("seen_before", F.col("matched") - F.col("new_sightings"))
    )
