"""Snapshot reconciliation over scripted polls."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postflow.operators import reconcile as R
from postflow.schemas import TABLES
from postflow.session import cut, working_folder
from postflow.sources import store

T0 = datetime(2026, 1, 1)
SNAPSHOT = "source STRING, source_job_id STRING, company_slug STRING, url STRING, raw STRING, raw_hash STRING, content_hash STRING, fetched_at TIMESTAMP"
RUNS = "company_slug STRING, source STRING, status STRING, item_count BIGINT, fetched_at TIMESTAMP"


def at(hours):
    return T0 + timedelta(hours=hours)


def poll(spark, hour, company, jobs, status="ok"):
    rows = [("gh", j, company, f"u/{t}", t, f"r-{t}", f"c-{t.lower()}", at(hour)) for j, t in jobs.items()]
    return (
        spark.createDataFrame(rows, SNAPSHOT),
        spark.createDataFrame([(company, "gh", status, len(jobs) if status == "ok" else None, at(hour))], RUNS),
    )


def empty_state(spark):
    return spark.createDataFrame([], TABLES["postings"])


def run(state, snapshot, runs, hour):
    return R.reconcile(state, snapshot, runs, F.lit(at(hour)))


def view(df):
    return {r["source_job_id"]: (r["is_open"], r["first_seen"], r["last_seen"], r["url"], r["content_hash"]) for r in df.collect()}


def script(spark):
    return [
        poll(spark, 0, "acme", {"1": "A", "2": "B"}),
        poll(spark, 1, "acme", {"1": "A"}),
        poll(spark, 2, "acme", {}, "failed"),
        poll(spark, 3, "acme", {}),
        poll(spark, 4, "acme", {"2": "B2", "3": "C"}),
    ]


def test_sequence_of_polls(spark):
    state = empty_state(spark)
    polls = script(spark)
    changes = []
    for hour, (snapshot, runs) in enumerate(polls):
        out = cut(run(state, snapshot, runs, hour))
        changes.append({r["source_job_id"]: r["change"] for r in out.collect()})
        state = out.drop("change")
    assert changes == [
        {"1": "new", "2": "new"},
        {"1": "seen", "2": "closed"},
        {"1": "untouched", "2": "untouched"},
        {"1": "untouched", "2": "untouched"},
        {"1": "closed", "2": "updated", "3": "new"},
    ]
    final = view(state)
    assert final == {
        "1": (False, at(0), at(1), "u/A", "c-a"),
        "2": (True, at(0), at(4), "u/B2", "c-b2"),
        "3": (True, at(4), at(4), "u/C", "c-c"),
    }
    snapshots, runs = polls[0]
    for s, r in polls[1:]:
        snapshots, runs = snapshots.unionByName(s), runs.unionByName(r)
    assert view(R.reconcile_polls(empty_state(spark), snapshots, runs)) == final


def test_twice_is_once(spark):
    snapshot, runs = poll(spark, 0, "acme", {"1": "A"})
    once = run(empty_state(spark), snapshot, runs, 0).drop("change")
    again = run(once, snapshot, runs, 0)
    assert view(again) == view(once) and {r["change"] for r in again.collect()} == {"seen"}


def test_other_boards_are_left_alone_and_foreign_keys_refused(spark):
    a, ra = poll(spark, 0, "acme", {"1": "A"})
    state = run(empty_state(spark), a, ra, 0).drop("change")
    b, rb = poll(spark, 1, "zeta", {"1": "Z", "9": "N"})
    out = run(state, b, rb, 1)
    assert view(out)["1"] == (True, at(0), at(0), "u/A", "c-a")
    assert view(out)["9"][0] is True
    refused = R.refused_sightings(state, b).collect()
    assert [(r["company_slug"], r["source_job_id"]) for r in refused] == [("zeta", "1")]
    # Two companies claiming one new key: the first by slug has it.
    both, runs = b.unionByName(a), rb.unionByName(ra)
    fresh = run(empty_state(spark), both, runs, 1)
    assert {r["source_job_id"]: r["company_slug"] for r in fresh.collect()} == {"1": "acme", "9": "zeta"}
    report = R.board_report(fresh, runs, R.refused_sightings(empty_state(spark), both),
                            both.limit(0), both.limit(0)).collect()
    rows = {r["company_slug"]: r.asDict() for r in report}
    assert rows["zeta"]["skipped"] == 1 and rows["zeta"]["new_postings"] == 1
    assert rows[None]["new_postings"] == 2 and rows[None]["fetched"] == 3


def test_latest_sighting_wins(spark):
    one, _ = poll(spark, 0, "acme", {"1": "A"})
    two, _ = poll(spark, 1, "acme", {"1": "B"})
    got = R.latest_sightings(one.unionByName(two)).collect()
    assert [(r["raw"], r["fetched_at"]) for r in got] == [("B", at(1))]


POSTING = "job_key STRING, source STRING, source_job_id STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, is_open BOOLEAN, content_hash STRING, title STRING, location_raw STRING, location STRUCT<regions: ARRAY<STRING>, region: STRING, work_mode: STRING>, description STRING, url STRING, posted_at TIMESTAMP"


def posting(job, pid, first, is_open, title="t", posted=None, hash_=None):
    return (job, "gh", pid, at(first), at(9), is_open, hash_ or f"h-{title}", title, "Lisbon",
            (["portugal"], "portugal", "onsite"), "d", f"u/{pid}", posted)


def job(spark, *rows):
    full = [
        {"job_key": k, "primary_source": "gh", "primary_source_job_id": p, "content_hash": h, "title": "old",
         "apply_url": "old", "last_seen": at(0), "first_seen": at(0), "posted_at": None}
        for k, p, h in rows
    ]
    return spark.createDataFrame(full, TABLES["jobs"])


def test_repoint_and_refresh(spark):
    postings = spark.createDataFrame([
        posting("j1", "a", 0, False), posting("j1", "b", 2, True, "new", at(-5)), posting("j1", "c", 1, True, "older", at(-3)),
        posting("j2", "d", 0, False), posting("j3", "e", 0, True, "same", None, "h-kept"),
    ], POSTING)
    jobs = job(spark, ("j1", "a", "h-t"), ("j2", "d", "h-t"), ("j3", "e", "h-kept"))
    moved = R.repoint(jobs, postings)
    got = {r["job_key"]: (r["primary_source_job_id"], r["repointed"]) for r in moved.collect()}
    assert got == {"j1": ("c", True), "j2": ("d", False), "j3": ("e", False)}
    fresh = {r["job_key"]: r for r in R.refresh_jobs(moved, postings).collect()}
    assert (fresh["j1"]["title"], fresh["j1"]["apply_url"], fresh["j1"]["posted_at"]) == ("older", "u/c", at(-5))
    assert fresh["j1"]["regions"] == ["portugal"] and fresh["j1"]["last_seen"] == at(9)
    assert (fresh["j3"]["title"], fresh["j3"]["apply_url"], fresh["j3"]["posted_at"]) == ("old", "old", None)


def test_sync_companies(spark):
    entry = "slug STRING, name STRING, ats_type STRING, ats_config MAP<STRING, STRING>, tier STRING, active BOOLEAN"
    watch = spark.createDataFrame([("a", "A2", "lever", {"token": "a"}, "lab", True), ("n", "N", "ashby", {}, "infra", False)], entry)
    stored = spark.createDataFrame([("a", "A", "lever", {}, "lab", False, at(0)), ("z", "Z", "lever", {}, "lab", True, at(0))], TABLES["companies"])
    got = {r["slug"]: (r["name"], r["active"], r["created_at"]) for r in R.sync_companies(stored, watch, F.lit(at(5))).collect()}
    assert got == {"a": ("A2", True, at(0)), "n": ("N", False, at(5)), "z": ("Z", False, at(0))}


def test_payloads_are_not_read(spark):
    """Neither stored nor listed payloads take part: the scans of both sides do without them."""
    snapshot, runs = poll(spark, 0, "acme", {"1": "A", "2": "B"})
    snapshot, state = cut(snapshot), cut(run(empty_state(spark), snapshot, runs, 0).drop("change"))
    for after in (run(state, snapshot, runs, 1), R.reconcile_polls(state, snapshot, runs)):
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert "raw_hash:string" in plan and "raw:string" not in plan


def test_untouched_parts_keep_their_files(spark):
    def files():
        found = store.read_state(spark, root).postings.select("company_slug", F.input_file_name().alias("file")).distinct()
        return {r["company_slug"]: r["file"] for r in found.collect()}

    root = working_folder(spark, "store")
    a, ra = poll(spark, 0, "acme", {"1": "A", "2": "B"})
    b, rb = poll(spark, 0, "zeta", {"9": "Z"})
    first = cut(run(empty_state(spark), a.unionByName(b), ra.unionByName(rb), 0).drop("change"))
    state = store.empty_state(spark).with_(postings=first, new_payloads=R.fresh_payloads(empty_state(spark), first, a.unionByName(b)))
    store.write_state(spark, root, state)
    before, stored = files(), store.read_state(spark, root)
    c, rc = poll(spark, 1, "acme", {"1": "A2"})
    after = cut(run(stored.postings, c, rc, 1).drop("change"))
    store.write_state(spark, root, stored.with_(postings=after, new_payloads=R.fresh_payloads(stored.postings, after, c)))
    assert files()["zeta"] == before["zeta"] and files()["acme"] != before["acme"]
    now = store.read_state(spark, root)
    assert view(now.postings) == {
        "1": (True, at(0), at(1), "u/A2", "c-a2"), "2": (False, at(0), at(0), "u/B", "c-b"), "9": (True, at(0), at(0), "u/Z", "c-z")}
    assert {r["source_job_id"]: r["raw"] for r in R.with_payloads(now.postings, now.all_payloads()).collect()} == {"1": "A2", "2": "B", "9": "Z"}
    assert view(store.read_state(spark, root, 1).postings)["1"] == (True, at(0), at(0), "u/A", "c-a")
    # A board that is gone altogether leaves no part behind.
    store.write_state(spark, root, now.with_(postings=now.postings.where("company_slug = 'acme'")))
    assert set(files()) == {"acme"}


def test_fresh_payloads_are_those_of_new_and_changed_postings(spark):
    first, runs = poll(spark, 0, "acme", {"1": "A", "2": "B"})
    before = cut(run(empty_state(spark), first, runs, 0).drop("change"))
    second, runs = poll(spark, 1, "acme", {"1": "A", "2": "B2", "3": "C"})
    refused, others = poll(spark, 1, "zeta", {"1": "Z"})
    both = second.unionByName(refused)
    after = cut(run(before, both, runs.unionByName(others), 1).drop("change"))
    payloads = R.fresh_payloads(empty_state(spark), before, first)
    fresh = R.fresh_payloads(before, after, both)
    assert sorted((r["source_job_id"], r["raw"]) for r in fresh.collect()) == [("2", "B2"), ("3", "C")]
    held = R.with_payloads(after, payloads.unionByName(fresh))
    assert sorted((r["source_job_id"], r["raw"]) for r in held.collect()) == [("1", "A"), ("2", "B2"), ("3", "C")]
