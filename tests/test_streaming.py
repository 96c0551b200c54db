"""Streaming forms give what the batch operators give."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from postflow.catalogue import tracking as C
from postflow.operators import reconcile as R, tracking as T
from postflow.schemas import TABLES
from postflow.session import working_folder
from postflow.streaming import incremental as S

T0 = datetime(2026, 1, 1)
LOG = "job_key STRING, action STRING, occurred_at TIMESTAMP, seq BIGINT, notes STRING"


def in_pieces(spark, frames, path):
    """One file per frame, read as a stream one file at a time, in order."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_event_fold(spark):
    rng = random.Random(11)
    actions = [*T.ACTIONS, "technical", "offer", "note", "rejected"]
    log = [(f"j{rng.randrange(8)}", rng.choice(actions), T0 + timedelta(hours=rng.randrange(60)), s, None) for s in range(120)]
    pieces = [spark.createDataFrame(log[i : i + 40], LOG) for i in range(0, 120, 40)]
    got = S.fold_event_stream(in_pieces(spark, pieces, working_folder(spark, "log")), working_folder(spark, "fold"))
    batch = T.fold_events(spark.createDataFrame(log, LOG))
    assert {tuple(r) for r in got["outcomes"].collect()} == {tuple(r) for r in batch.outcomes.collect()}
    assert {tuple(r) for r in got["events"].collect()} == {tuple(r) for r in batch.events.collect()}
    assert {(r["job_key"], r["status"]) for r in got["applications"].collect()} == {
        (r["job_key"], r["status"]) for r in batch.applications.collect()}


def test_event_fold_goes_on_from_stored_state(spark):
    log = [("a", "apply"), ("b", "dismiss"), ("a", "offer"), ("b", "undismiss"), ("a", "offer"), ("b", "note"), ("c", "dismiss")]
    rows = [(job, action, T0 + timedelta(hours=s), s, None) for s, (job, action) in enumerate(log)]
    pieces = [spark.createDataFrame(rows[i : i + n], LOG) for i, n in ((0, 2), (2, 2), (4, 1), (5, 2))]
    landed, root = working_folder(spark, "log"), working_folder(spark, "fold")
    S.fold_event_stream(in_pieces(spark, pieces[:2], landed), root, compact_every=2)
    got = S.fold_event_stream(in_pieces(spark, pieces[2:], landed), root, compact_every=2)
    outcomes = {r["seq"]: r["reason"] for r in got["outcomes"].collect()}
    assert outcomes == {0: "applied", 1: "dismissed", 2: "recorded", 3: "undismissed", 4: "refused: already recorded",
                        5: "refused: no application", 6: "dismissed"}
    assert {(r["job_key"], r["status"]) for r in got["applications"].collect()} == {("a", "offer"), ("c", "dismissed")}
    assert sorted((r["job_key"], r["event"]) for r in got["events"].collect()) == [("a", "applied"), ("a", "offer")]
    folder = Path(root.removeprefix("file:"), "applications")
    assert sorted(f.name for f in folder.iterdir()) == ["base=1", "batch=2", "batch=3"]  # older batches went into the base
    # A batch writes what it changed: nothing, then one job.
    assert [spark.read.parquet(f"{root}/applications/batch={n}").count() for n in (2, 3)] == [0, 1]


def test_large_pieces_are_landed_in_several_files_and_still_make_a_batch_each(spark, tmp_path, monkeypatch):
    kinds = ["signup", "purchase", "error", "view", "click"]
    rows = [(i, T0 + timedelta(hours=i), i % 7, kinds[i % 5], float(i % 150)) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(C, "FILE_ROWS", 5)
    seen = {}

    def spy(log, root, compact_every):
        result = S.fold_event_stream(log, root, compact_every)
        seen.update(files=len(log.sparkSession.read.parquet(folders[0]).inputFiles()), root=root)
        return result

    folders = []
    monkeypatch.setattr(C, "working_folder", lambda session, name: (folders.append(f"{tmp_path}/{name}"), folders[-1])[1])
    monkeypatch.setattr(C, "fold_event_stream", spy)
    got = {tuple(r) for r in C.stream_event_fold(spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in C.event_fold(spark, str(tmp_path)).collect()}
    assert seen["files"] == 24  # six pieces of 20 rows, four files each
    assert len(list(Path(f"{seen['root']}/outcomes").iterdir())) == 6
    assert C._files([0, 10, 10], 8) == 1 and C._files([100, 100, 100], 8) == 8


def test_reconcile(spark):
    listing = "company_slug STRING, source STRING, source_job_id STRING, fetched_at TIMESTAMP, text STRING"

    def poll(hour, *jobs):
        return spark.createDataFrame([("acme", "gh", j, T0 + timedelta(hours=hour), t) for j, t in jobs], listing)

    def parse(rows):
        hashed = F.sha2("text", 256)
        snapshot = rows.select("source", "source_job_id", "company_slug", F.col("text").alias("url"), F.col("text").alias("raw"),
                               hashed.alias("raw_hash"), hashed.alias("content_hash"), "fetched_at")
        runs = rows.groupBy("company_slug", "source", "fetched_at").agg(F.count(F.lit(1)).alias("item_count"), F.lit("ok").alias("status"))
        return snapshot, runs

    polls = [poll(0, ("1", "a"), ("2", "b")), poll(1, ("1", "a")), poll(2, ("1", "a2"), ("3", "c"))]
    state = working_folder(spark, "state")
    after = S.reconcile_stream(in_pieces(spark, polls, working_folder(spark, "landed")), state, parse, compact_every=2)
    for table in ("postings", "payloads"):  # what the base replaces is gone
        assert sorted(f.name for f in Path(state.removeprefix("file:"), table).iterdir()) == ["base=1", "batch=2"]
    got = {r["source_job_id"]: (r["is_open"], r["first_seen"], r["last_seen"], r["raw"]) for r in after.collect()}
    at = [T0 + timedelta(hours=h) for h in range(3)]
    assert got == {"1": (True, at[0], at[2], "a2"), "2": (False, at[0], at[0], "b"), "3": (True, at[2], at[2], "c")}
    snapshots, runs = parse(polls[0].unionByName(polls[1]).unionByName(polls[2]))
    nothing = spark.createDataFrame([], TABLES["postings"])
    batch = R.reconcile_polls(nothing, snapshots, runs)
    batch = R.with_payloads(batch, R.fresh_payloads(nothing, batch, snapshots))
    assert {r["source_job_id"]: (r["is_open"], r["first_seen"], r["last_seen"], r["raw"]) for r in batch.collect()} == got


def test_sightings_are_kept_once(spark):
    schema = "source STRING, source_job_id STRING, n INT"
    pieces = [spark.createDataFrame([("hn", "1", 1), ("hn", "2", 1)], schema), spark.createDataFrame([("hn", "2", 2), ("hn", "3", 2)], schema)]
    kept = S.write_sightings(in_pieces(spark, pieces, working_folder(spark, "seen")), working_folder(spark, "out"))
    assert sorted((r["source_job_id"], r["n"]) for r in kept.collect()) == [("1", 1), ("2", 1), ("3", 2)]
