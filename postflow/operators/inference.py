"""Batch inference with a caller-supplied function: once per distinct text, written once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import render_posting
from ..schemas import EXTRACTION, TIER_SUGGESTION, VERDICT, struct_of
from ..session import arrow_batches, cut
from ..sources.store import is_written
from .prefilter import POSTING_KEY
from .ranking import first_rows

# A batch of rows with a `text` column in, the declared answer columns out, same order.
BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


class FatalInferenceError(Exception):
    """An error that would hit every row alike, such as a rejected key. Aborts the job."""


# What the reason of a row starts with that was not asked, or lost, because of a fatal error.
FATAL = "fatal: "
PER_TASK = 500
# What a worker holds of the rows it is asked about follows these, not the size of the table.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def _asked(df: DataFrame, fn: BatchFunction, answer: str, keys: list[str], keep_fatal: bool) -> DataFrame:
    """`fn` over every row of `df`; after a fatal error the rest of a task is not asked, or the task fails."""
    fields = struct_of(answer)
    schema = T.StructType([df.schema[k] for k in keys] + fields.fields)
    names = fields.fieldNames()

    def answered(batch: pd.DataFrame) -> pd.DataFrame:
        result = fn(batch).reset_index(drop=True)
        if len(result) != len(batch):
            raise ValueError(f"{len(batch)} rows in, {len(result)} answers out")
        return result

    def collect(batch: pd.DataFrame, parts: list[pd.DataFrame]) -> None:
        try:
            parts.append(answered(batch))
        except FatalInferenceError:
            raise
        except Exception as problem:  # noqa: BLE001 - kept as data, at the row that failed
            if len(batch) == 1:
                parts.append(pd.DataFrame({"error": [f"{type(problem).__name__}: {problem}"]}))
            else:
                for position in range(len(batch)):
                    collect(batch.iloc[position : position + 1], parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for batch in batches:
            if len(batch) == 0:
                continue
            parts: list[pd.DataFrame] = []
            try:
                if stopped is None:
                    collect(batch, parts)
            except FatalInferenceError as problem:
                if not keep_fatal:
                    raise
                stopped = problem
            left = len(batch) - sum(map(len, parts))
            if left:
                parts.append(pd.DataFrame({"error": [f"{FATAL}{stopped}"] * left}))
            result = pd.concat(parts, ignore_index=True).reindex(columns=names).astype(object)
            result = result.where(result.notna(), None)
            yield pd.concat([batch[keys].reset_index(drop=True), result], axis=1)

    return df.mapInPandas(run, schema)


def infer(df: DataFrame, fn: BatchFunction, answer: str, keys: list[str]) -> DataFrame:
    """`fn` over every row of `df`; returns `keys` and the columns of the `answer` schema.

    A batch that raises is retried row by row, and a row that raises keeps its place with
    the reason in `error`. A batch has at most `BATCH_ROWS` rows and, but for a longer single
    row, about `BATCH_BYTES` bytes. Materialised before it is returned, so a later join never
    calls `fn` again.
    """
    with arrow_batches(df.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return cut(_asked(df, fn, answer, keys, keep_fatal=False))


def stored_answers(spark, store: str, version: str, schema: T.StructType) -> DataFrame:
    """All answers and failures kept under `store` for a version, one row per attempt."""
    folder = f"{store}/{quote(version, safe='')}"
    schema = T.StructType([*schema.fields, T.StructField("asked_at", T.TimestampType())])
    return spark.read.schema(schema).parquet(folder) if is_written(spark, folder) else spark.createDataFrame([], schema)


def infer_stored(
    df: DataFrame, fn: BatchFunction, answer: str, keys: list[str], store: str, version: str,
    valid: Column | None = None, per_task: int = PER_TASK, derived: dict[str, Column] | None = None,
) -> DataFrame:
    """As `infer`, but answers outlive a run that dies: a key is asked only while `store` has no answer to it.

    Answers are kept by `keys` and `version` (of the model and the prompt). A task commits the
    answers to its `per_task` rows, about, when it ends, whatever becomes of the others. On a
    fatal error a task keeps the answers it has, asks no further and is not repeated; once all are
    written FatalInferenceError is raised. Failures, and answers that are not `valid`, are kept
    as well but are asked again by the next run. Repeated keys are asked once. Returns the last
    valid answer, or else the last failure, to each key of `df`. The columns `derived` are
    added where a row is asked, so they do not travel.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[k] for k in keys] + struct_of(answer).fields)
    fine = F.col("error").isNull()
    if valid is not None:
        fine = fine & F.coalesce(valid, F.lit(False))
    wanted = cut(df.select(*keys).distinct())
    held = stored_answers(spark, store, version, schema).where(fine).select(*keys)
    missing = cut(wanted.join(held, keys, "left_anti"))
    rows = missing.count()
    if rows:
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_task))
        # The rows are dealt once; of repeated keys one is taken where they already lie together.
        asked = df.join(missing, keys, "left_semi").repartition(tasks, *keys).dropDuplicates(keys).withColumns(derived or {})
        answers = _asked(asked, fn, answer, keys, keep_fatal=True).withColumn("asked_at", F.current_timestamp())
        with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
            # This version of the committer puts the file of a task in place when the task ends.
            answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(
                f"{store}/{quote(version, safe='')}")
    others = [f.name for f in schema.fields if f.name not in keys]
    last = F.max_by(F.struct(*others), F.struct(fine, "asked_at"))
    found = stored_answers(spark, store, version, schema).join(wanted, keys, "left_semi").groupBy(*keys).agg(last.alias("_last"))
    found = cut(found.select(*keys, "_last.*"))
    stopped = found.where(F.col("error").startswith(FATAL)).select("error").first()
    if stopped:
        raise FatalInferenceError(stopped["error"].removeprefix(FATAL))
    return found


def failure_counts(answers: DataFrame) -> DataFrame:
    """How many rows were attempted and how many failed."""
    return answers.agg(
        F.count(F.lit(1)).alias("attempted"), F.count("error").alias("failed")
    )


def require_answers(answers: DataFrame, max_failed_share: float) -> None:
    """Raise when more than this share of the calls failed. Read after the answers are stored."""
    row = failure_counts(answers).first()
    if row["attempted"] and row["failed"] / row["attempted"] > max_failed_share:
        sample = answers.where("error IS NOT NULL").select("error").first()[0]
        raise RuntimeError(f"{row['failed']} of {row['attempted']} calls failed, one of them with: {sample}")


# --- scoring -----------------------------------------------------------------------------


def text_groups(candidates: DataFrame) -> DataFrame:
    """One row per distinct text: its first-seen posting and how many postings share it."""
    return candidates.groupBy("content_hash").agg(
        F.min(F.struct("first_seen", *POSTING_KEY)).alias("lead"),
        F.count(F.lit(1)).alias("postings"),
    )


def capped_groups(candidates: DataFrame, cap: int | None) -> DataFrame:
    """The texts to score: all, or the `cap` of them seen first; the cap counts texts, not postings."""
    return first_rows(text_groups(candidates), [F.col("lead")], cap)


def band_mismatch(band: Column, score: Column, bands) -> Column:
    """True when the named band is unknown or does not hold the score. False without bands."""
    if not bands:
        return F.lit(False)
    wanted = F.lower(F.btrim(F.trim(band), F.lit(".")))
    fits = F.coalesce(*[F.when(wanted == b.name.lower(), score.between(b.low, b.high)) for b in bands])
    return ~F.coalesce(fits, F.lit(False))


def score_texts(
    candidates: DataFrame, texts: DataFrame, scorer: BatchFunction, profile, model: str, scored_at,
    cap: int | None = None, store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores, verdicts): one call per distinct text, one score row per posting of it.

    `candidates` are `disposition` rows and `texts` the replayed records. Each call sees
    `text` (the rendered posting) and the lead posting's columns; only leads meet their text. A verdict outside 0..100 counts as failed. Failed texts
    stay in `verdicts` with their reason and produce no score rows, so they return. With a
    `store` the answers outlive a run that dies, see `infer_stored`.
    """
    groups = capped_groups(candidates, cap if cap is not None else profile.max_scores_per_run)
    leads = groups.select("content_hash", "lead.source", "lead.source_job_id")
    # The lead is found by its own key, so a text shared by many postings does not skew this join.
    described = texts.select(*POSTING_KEY, "title", "location_raw", "description")
    asked = leads.join(candidates, [*POSTING_KEY, "content_hash"]).join(described, POSTING_KEY).select(
        "content_hash", "company", "title", "location_raw", "region", "work_mode", "description",
    )
    # Rendered after the shuffle, which thus carries each description once.
    text = {"text": render_posting(F.col("company"), F.col("title"), F.col("location_raw"), F.col("region"),
                                   F.col("work_mode"), F.col("description"))}
    in_range = F.col("score").between(0, 100)
    if store is None:
        answers = infer(asked.repartition("content_hash").withColumns(text), scorer, VERDICT, ["content_hash"])
    else:
        answers = infer_stored(
            asked, scorer, VERDICT, ["content_hash"], store, f"{model}-{profile.prompt_version}", in_range,
            derived=text)
    verdicts = answers.withColumn(
        "error",
        F.coalesce("error", F.when(~F.coalesce(in_range, F.lit(False)), F.lit("score outside 0..100"))),
    ).withColumn("band_mismatch", F.col("error").isNull() & band_mismatch(F.col("band"), F.col("score"), profile.bands))
    scores = (
        candidates.select(*POSTING_KEY, "content_hash", "location_fit")
        .join(verdicts.where("error IS NULL"), "content_hash")
        .select(
            *POSTING_KEY, "content_hash", F.lit(profile.prompt_version).alias("prompt_version"),
            "score", "summary", "rationale", "matched_areas", "concerns", "work_authorization",
            "location_fit", F.lit(model).alias("model"), F.lit(scored_at).cast("timestamp").alias("scored_at"),
        )
    )
    return scores, verdicts


def append_scores(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """Stored scores plus the new ones; a key already stored keeps its first verdict."""
    key = [*POSTING_KEY, "content_hash", "prompt_version"]
    return stored.unionByName(scores.join(stored, key, "left_anti"))


def scoring_report(counts: DataFrame, verdicts: DataFrame, scores: DataFrame, cap: int | None) -> DataFrame:
    """The prefilter funnel with what the scorer did, as one row."""
    spent = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
    calls = verdicts.agg(
        F.count_if(F.col("error").isNull()).alias("judged"),
        F.count("error").alias("failed"),
        F.count_if("band_mismatch").alias("band_mismatches"),
        F.count_if(F.col("error").isNull() & (F.coalesce("cache_read_input_tokens", F.lit(0)) == 0)).alias("uncached"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in spent],
    )
    written = scores.agg(F.count(F.lit(1)).alias("scored"))
    # Three frames of exactly one row each.
    one = F.lit(1).alias("_one")
    joined = counts.drop("carried_over").select("*", one)
    for part in (calls, written):
        joined = joined.join(part.select("*", one), "_one")
    return (
        joined.drop("_one")
        .withColumn("cap", F.lit(cap).cast("bigint"))
        # The first call of a run has nothing to read from a cache.
        .withColumn("cold_calls", F.greatest(F.col("uncached") - 1, F.lit(0)))
        .withColumn("carried_over", F.greatest(F.col("distinct_texts") - F.col("judged") - F.col("failed"), F.lit(0)))
        .drop("uncached")
    )


# --- other answers -----------------------------------------------------------------------


def extract_companies(prose: DataFrame, extractor: BatchFunction, cap: int | None, order: list) -> DataFrame:
    """Company, roles and careers link read out of prose postings.

    `prose` holds the posting key and `text`. A cap, if the caller has one, serves every source
    of a run; texts beyond it and texts that failed are not remembered and come back next run.
    """
    chosen = first_rows(prose, order, cap).repartition(*POSTING_KEY)
    return infer(chosen, extractor, EXTRACTION, POSTING_KEY)


def classify(entities: DataFrame, classifier: BatchFunction | None, keys: list[str], labels: list[str],
             default: str) -> DataFrame:
    """A label per entity: `default` for an answer outside `labels`, null for a failed call.

    Without a classifier nothing can be said and every entity has a null label.
    """
    if classifier is None:
        return entities.select(*keys, F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("because"))
    answers = infer(entities, classifier, TIER_SUGGESTION, keys)
    settled = F.when(F.col("tier").isin(labels), F.col("tier")).otherwise(F.lit(default))
    return answers.select(*keys, F.when(F.col("error").isNull(), settled).alias("tier"), "because")


def describe_entity(name, careers_url, ats, token, board_jobs, roles, titles) -> Column:
    """What a classifier reads about one queued company."""
    def line(label: str, *parts) -> Column:
        values = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.concat(F.lit(label), *values)

    return F.concat_ws(
        "\n",
        line("Company: ", name),
        F.when(careers_url != "", line("Careers page: ", careers_url)),
        F.when(ats.isNotNull(), line("Job board: ", ats, " '", token, "' with ",
                                     F.coalesce(board_jobs, F.lit(0)).cast("string"), " open postings")),
        F.when(F.size(roles) > 0, line("Roles seen: ", F.array_join(roles, "; "))),
        F.transform(titles, lambda t: F.concat(F.lit("Seen hiring: "), t)),
    )
