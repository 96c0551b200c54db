"""Whole runs: landed responses to openings, scores, a digest, and candidate companies."""

import json
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postflow.catalogue.scoring import first_words
from postflow.operators import ranking as K, tracking as T
from postflow.operators import inference
from postflow.operators.inference import FatalInferenceError, infer, infer_stored, require_answers
from postflow.operators.places import LocationRule
from postflow.plans import digest as D
from postflow.plans.discover import run_discovery
from postflow.plans.ingest import run_ingest
from postflow.plans.profile import Band, RepeatRules, SearchProfile, profile_from_settings
from postflow.plans.score import run_scoring
from postflow.schemas import LANDED, TABLES
from postflow.session import cut, working_folder
from postflow.sources.dimensions import InvalidInput, LABELLED, WATCHLIST, load_labelled, load_watchlist
from postflow.sources.store import empty_state, read_state, versions, write_digest, write_state

T0 = datetime(2026, 1, 5, 8)
PROFILE = SearchProfile(
    title_include=["research scientist"], title_exclude=["intern"], strong=["RLHF"], supporting=["evals"],
    seniority_exclude=["director"], priority=[LocationRule(("onsite",), ("portugal",))],
    acceptable=[LocationRule(("remote",), ("us",))], bands=[Band("Core", 70, 100), Band("Rest", 0, 69)],
    threshold=70, max_scores_per_run=10, prompt_version=1,
)
RULES = RepeatRules(demote_after=3, suppress_after=5, reset_on_score_delta=10)


def at(hours):
    return T0 + timedelta(hours=hours)


def greenhouse(jobs):
    return json.dumps({"jobs": [
        {"id": i, "title": t, "absolute_url": f"u/{i}/{len(d)}", "location": {"name": place}, "content": f"&lt;p&gt;{d}&lt;/p&gt;",
         "updated_at": "2026-01-01T00:00:00Z"} for i, t, place, d in jobs]})


def ashby(jobs):
    return json.dumps({"jobs": [
        {"id": i, "title": t, "jobUrl": f"a/{i}", "location": place, "descriptionPlain": d, "publishedAt": "2025-12-01T00:00:00Z"}
        for i, t, place, d in jobs]})


def landed(spark, *rows):
    return spark.createDataFrame([(s, c, at(h), code, body) for s, c, h, code, body in rows], LANDED)


def watchlist(spark):
    return load_watchlist(spark.createDataFrame([
        ("acme", "Acme", "greenhouse", "acme", "lab", True), ("zeta", "Zeta", "ashby", "zeta", None, None),
    ], WATCHLIST))


def keep(state):
    """The state written out, as between two runs."""
    return state.with_(**{name: cut(df) for name, df in state.frames().items()})


def test_runs_over_a_week(spark):
    def by_length(batch):
        return pd.DataFrame({
            "score": [60 + len(d) for d in batch["description"]], "band": ["core"] * len(batch),
            "summary": ["s"] * len(batch), "concerns": [["c"]] * len(batch), "work_authorization": ["eligible"] * len(batch)})

    watch = watchlist(spark)
    first = landed(
        spark,
        ("greenhouse", "acme", 0, 200, greenhouse([
            (1, "Research Scientist, Evals", "Lisbon, Portugal", "RLHF work here"),
            (2, "Research Scientist, Post-Training", "Lisbon", "RLHF and evals a lot"),
            (3, "Intern", "Lisbon", "RLHF"), (4, "Cook", "Lisbon", "soup")])),
        ("ashby", "zeta", 0, 200, ashby([("z1", "Research Scientist", "Tokyo", "RLHF"), ("z2", "Director", "Lisbon", "RLHF")])),
        ("greenhouse", "gone", 0, 200, greenhouse([(9, "X", "Lisbon", "y")])),
    )
    run = run_ingest(empty_state(spark), first, watch, F.lit(at(0)))
    state = keep(run.state)
    report = {r["company_slug"]: r.asDict() for r in run.report.collect()}
    assert report["acme"]["new_jobs"] == 4 and report["zeta"]["new_postings"] == 2 and report[None]["fetched"] == 6
    assert state.jobs.count() == 6 and state.postings.where("job_key IS NULL").count() == 0

    # A retitle onto an existing opening merges, a vanished posting closes, a failed board keeps its own.
    second = landed(
        spark,
        ("greenhouse", "acme", 2, 200, greenhouse([
            (1, "Research Scientist, Post-Training", "Lisbon, Portugal", "RLHF work here, new"),
            (2, "Post-Training Research Scientist", "Lisbon", "RLHF and evals a lot"), (3, "Intern", "Lisbon", "RLHF")])),
        ("ashby", "zeta", 2, 503, None),
    )
    run = run_ingest(state, second, watch, F.lit(at(2)))
    state = keep(run.state)
    rows = {(r["company_slug"], r["source_job_id"]): r for r in state.postings.collect()}
    assert rows["acme", "4"]["is_open"] is False and rows["zeta", "z1"]["is_open"] is True
    assert rows["acme", "1"]["job_key"] == rows["acme", "2"]["job_key"]
    report = {r["company_slug"]: r.asDict() for r in run.report.collect()}
    assert (report["acme"]["closed"], report["acme"]["updated"], report["zeta"]["failed"]) == (1, 2, 1)
    assert state.jobs.count() == 5 and state.jobs.groupBy("canonical_key").count().where("count > 1").isEmpty()

    # The primary posting of the merged opening closes: the opening moves to the other one.
    merged = state.jobs.where(F.col("job_key") == rows["acme", "1"]["job_key"]).first()
    other = {"1": "2", "2": "1"}[merged["primary_source_job_id"]]
    third = landed(spark, ("greenhouse", "acme", 3, 200, greenhouse([
        (int(other), "Post-Training Research Scientist", "Lisbon", "RLHF and evals a lot"), (3, "Intern", "Lisbon", "RLHF")])))
    run = run_ingest(state, third, watch, F.lit(at(3)), only=["acme"])
    state = keep(run.state)
    moved = state.jobs.where(F.col("job_key") == merged["job_key"]).first()
    assert moved["primary_source_job_id"] == other and moved["region"] == "portugal"

    # Scoring: one call per text, and a second run finds nothing left.
    dry = run_scoring(state, PROFILE, None, "m", F.lit(at(4)))
    assert dry.report.first()["candidates"] == 1
    scored = run_scoring(state, PROFILE, by_length, "m", F.lit(at(4)))
    state = keep(scored.state)
    line = scored.report.first()
    assert (line["open_postings"], line["eliminated_title"], line["eliminated_location"], line["judged"], line["scored"]) == (4, 2, 1, 1, 1)
    assert run_scoring(state, PROFILE, by_length, "m", F.lit(at(5))).report.first()["unjudged_postings"] == 3

    # The digest shows it, sinks it after three showings and folds it away after five.
    day = date(2026, 1, 5)

    def digest(n):
        return D.daily_digest(state, PROFILE, RULES, F.lit(day + timedelta(days=n)), F.lit(at(24 * n)), "Europe/Lisbon")

    def shown(entries):
        return [(r["section"], r["position"], r["title"], r["appearance"], r["demoted"]) for r in entries.collect()]

    first_day, _ = digest(0)
    assert shown(first_day) == [("priority", 1, "Post-Training Research Scientist", 1, False)]
    history = state.digest_appearances
    for n in range(5):
        history = K.record_appearances(history, first_day, day + timedelta(days=n))
    history = cut(history)
    assert K.record_appearances(history, first_day, day).count() == 5
    state = keep(state.with_(digest_appearances=history))
    assert shown(digest(3)[0]) == [("priority", 1, "Post-Training Research Scientist", 4, True)]
    entries, summary = digest(5)
    assert shown(entries) == [] and summary.first()["still_open"] == 1 and summary.first()["is_empty"]

    roles, total = D.open_roles(state, PROFILE, RULES)
    assert [(r["appearances"], r["suppressed"]) for r in roles.collect()] == [(5, True)] and total.first()[0] == 1
    log = state.jobs.select("job_key", F.lit("apply").alias("action"), F.lit(at(9)).alias("occurred_at"),
                            F.lit(1).alias("seq"), F.lit(None).cast("string").alias("notes")).where(F.col("title") == "Post-Training Research Scientist")
    fold = T.fold_events(log)
    state = keep(state.with_(applications=fold.applications, application_events=fold.events))
    board = D.dashboard(state, PROFILE, RULES)
    assert board["open_roles"].isEmpty() and board["open_total"].first()[0] == 0
    assert [(r["status"], r["applications"]) for r in board["pipeline"].collect()] == [("applied", 1)]
    assert {r["slice"]: r["applied"] for r in board["response_rates"].collect()} == {"all": 1, "source": 1, "tier": 1}
    assert board["applications"].first()["company"] == "Acme" and board["dismissed_total"].first()[0] == 0
    for df in board.values():
        df.collect()

    # Written and read back, version by version.
    root = working_folder(spark, "state")
    assert versions(spark, root) == [] and read_state(spark, root).jobs.isEmpty()
    write_state(spark, root, state)
    write_state(spark, root, state.with_(jobs=state.jobs.limit(0)))
    assert versions(spark, root) == [1, 2] and read_state(spark, root).jobs.isEmpty()
    assert read_state(spark, root, 1).jobs.count() == state.jobs.count()
    assert read_state(spark, root).digest_appearances.count() == 5


def test_discovery(spark):
    watch = watchlist(spark)
    hn = json.dumps({"id": 7, "children": [
        {"id": 71, "text": "Newco | Research Scientist | Lisbon<p>RLHF all day. jobs.lever.co/newco", "created_at": "2026-01-01T00:00:00Z"},
        {"id": 72, "text": "Agency | RLHF", "created_at": "2026-01-01T00:00:00Z"}, {"id": 73, "text": None},
        {"id": 74, "text": "Third | Research Scientist", "created_at": "2026-01-02T00:00:00Z"}]})
    remotive = json.dumps({"jobs": [
        {"id": 1, "title": "Research Scientist", "company_name": "Newco", "url": "r/1", "candidate_required_location": "EU",
         "publication_date": "2026-01-01T00:00:00", "description": "<p>x</p>"},
        {"id": 2, "title": "Research Scientist", "company_name": "Acme", "url": "r/2", "description": "<p>x</p>"},
        {"id": 3, "title": "Research Scientist Intern", "company_name": "Other", "description": "RLHF"},
        {"id": 4, "title": "Cook", "company_name": "Other", "description": "evals of soup"}]})
    rows = landed(spark, ("hn", None, 0, 200, hn), ("remotive", None, 0, 200, remotive), ("remoteok", None, 0, 500, ""))
    boards = spark.createDataFrame([("lever", "newco", 4), ("ashby", "newco", 9)], "ats_type STRING, ats_token STRING, board_jobs BIGINT")

    def extractor(batch):
        names = [t.split("\n")[1].split(" |")[0] for t in batch["text"]]
        return pd.DataFrame({
            "company": [None if n == "Agency" else n for n in names], "roles": [["Scientist"]] * len(batch),
            "careers_url": ["https://jobs.lever.co/newco" if n == "Newco" else None for n in names]})

    run = run_discovery(empty_state(spark), rows, watch, boards, PROFILE, extractor, F.lit(at(0)), 2, 7)
    state = keep(run.state)
    got = {r["name_key"]: r for r in state.candidate_companies.collect()}
    assert set(got) == {"newco"}
    newco = got["newco"]
    assert (newco["ats_type"], newco["ats_token"], newco["sightings"], newco["status"]) == ("lever", "newco", 2, "pending")
    assert newco["careers_url"] == "https://jobs.lever.co/newco" and len(newco["evidence"]) == 2
    report = {r["source"]: r.asDict() for r in run.report.collect()}
    assert (report["hn"]["extracted"], report["hn"]["capped"], report["hn"]["unattributed"]) == (2, 1, 1)
    assert (report["remotive"]["matched"], report["remotive"]["already_watched"], report["remoteok"]["failed"]) == (2, 1, 1)
    assert report[None]["new_candidate"] == 1 and report[None]["boards_found"] == 1
    # What was over the cap was not remembered: it comes back, and nothing else is read again.
    second = run_discovery(state, rows, watch, boards, PROFILE, extractor, F.lit(at(200)), 5, 7)
    outcomes = {r["source_job_id"]: r["outcome"] for r in second.outcomes.collect()}
    assert outcomes == {"74": "new_candidate"}
    assert second.state.postings.where("source_job_id = '71'").first()["last_seen"] == at(200)


def test_inference_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(6)], "content_hash STRING, text STRING")

    def picky(batch):
        if (batch["text"] == "t3").any():
            raise ValueError("no answer")
        return pd.DataFrame({"company": batch["text"], "roles": [["a", "b"]] * len(batch)})

    got = {r["content_hash"]: (r["company"], r["roles"], r["error"]) for r in infer(
        df.coalesce(1), picky, "company STRING, roles ARRAY<STRING>, error STRING", ["content_hash"]).collect()}
    assert got["3"] == (None, None, "ValueError: no answer") and got["5"] == ("t5", ["a", "b"], None)
    answers = infer(df, picky, "company STRING, roles ARRAY<STRING>, error STRING", ["content_hash"])
    require_answers(answers, 0.5)
    with pytest.raises(RuntimeError, match="1 of 6"):
        require_answers(answers, 0.1)

    def rejected(batch):
        raise FatalInferenceError("bad key")

    with pytest.raises(Exception, match="bad key"):
        infer(df, rejected, "company STRING, error STRING", ["content_hash"])


def test_batches_do_not_grow_with_the_table(spark):
    """A worker is handed few rows and bytes at a time, and the session's own setting is left as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batch):
        return pd.DataFrame({"company": [str(len(batch))] * len(batch)})

    def largest(n, width):
        rows = spark.range(n).select(F.col("id").alias("k"), F.repeat(F.lit("x"), width).alias("text")).coalesce(1)
        return infer(rows, sizes, "company STRING, error STRING", ["k"]).agg(F.max(F.col("company").cast("int"))).first()[0]

    assert largest(3000, 5) <= 256
    assert largest(100, 1 << 20) <= 16  # of a megabyte each
    assert spark.conf.get(name) == before


def test_stored_answers_deal_texts_once(spark, tmp_path):
    """The texts that are asked about are shuffled once, whether keys repeat or not."""
    df = spark.range(200).select((F.col("id") % 100).cast("string").alias("content_hash"), F.lit("t").alias("description"))
    plans = []
    real = inference._asked

    def spy(rows, *args, **named):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        assert "text" in rows.columns
        return real(rows, *args, **named)

    inference._asked = spy
    try:
        got = infer_stored(df, lambda b: pd.DataFrame({"company": b["text"]}), "company STRING, error STRING", ["content_hash"],
                           str(tmp_path / "store"), "1", derived={"text": F.concat("description", F.lit("!"))})
    finally:
        inference._asked = real
    assert [r["company"] for r in got.collect()] == ["t!"] * 100
    assert plans[0].index("Aggregate") < plans[0].index("RepartitionByExpression")  # it is dealt below, not again above


def test_a_retried_row_is_read_without_column_functions(monkeypatch):
    monkeypatch.delattr(pd.Series, "str")
    got = first_words(pd.DataFrame({"text": ["a b c d e", "  "]}))
    assert got["company"].tolist() == ["a", None] and got["roles"].tolist() == [["b", "c"], []]
    with pytest.raises(ValueError, match="unreadable"):
        first_words(pd.DataFrame({"text": ["a b", ""]}))
    with pytest.raises(TypeError, match="'NoneType' object is not iterable"):
        first_words(pd.DataFrame({"text": [None]}))


def test_stored_answers_outlive_a_failed_run(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(40)] * 2, "content_hash STRING, text STRING")
    answer, log = "company STRING, error STRING", tmp_path / "asked"
    log.mkdir()

    def scorer(rejecting):
        def ask(batch):
            if len(batch) > 1:
                raise ValueError("one at a time")
            text = batch["text"].iloc[0]
            if rejecting and text == "t7":
                raise FatalInferenceError("bad key")
            with open(log / text, "a") as f:
                f.write("x")
            if text == "t3":
                raise ValueError("no answer")
            return pd.DataFrame({"company": [text]})
        return ask

    def calls():
        return {p.name: len(p.read_text()) for p in log.iterdir()}

    def ask(fn, version="m/1", rows=df):
        return infer_stored(rows, fn, answer, ["content_hash"], str(tmp_path / "store"), version)

    with pytest.raises(FatalInferenceError, match="bad key"):
        ask(scorer(True))
    first = calls()
    assert 0 < len(first) < 40 and set(first.values()) == {1}
    got = {r["content_hash"]: (r["company"], r["error"]) for r in ask(scorer(False)).collect()}
    assert len(got) == 40 and got["3"] == (None, "ValueError: no answer") and got["7"] == ("t7", None)
    assert {t: n for t, n in calls().items() if n > 1} == ({"t3": 2} if "t3" in first else {})  # only a failure is asked again
    before = calls()
    assert ask(scorer(False)).count() == 40
    assert {t for t, n in calls().items() if n > before[t]} == {"t3"}
    assert ask(scorer(False), rows=df.limit(0)).count() == 0
    assert ask(scorer(False), "m/2").count() == 40 and calls()["t9"] == 2  # another version is asked anew


def test_caps_are_cut_by_position(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("n"))
    assert sorted(r["n"] for r in K.first_rows(df, [F.col("n")], 123).collect()) == list(range(123))
    assert K.first_rows(df, [F.col("n")], None).count() == 500


def test_inputs_are_checked(spark):
    def entries(*rows):
        return spark.createDataFrame(rows, WATCHLIST)

    with pytest.raises(InvalidInput, match="duplicate slug"):
        load_watchlist(entries(("a", "A", "lever", "a", "lab", True), ("a", "B", "lever", "b", "lab", True)))
    with pytest.raises(InvalidInput, match="unknown board type"):
        load_watchlist(entries(("a", "A", "workday", "a", "lab", True)))
    with pytest.raises(InvalidInput, match="missing slug"):
        load_watchlist(entries(("a", "A", "lever", " ", "lab", True)))
    good = ("1", "A", "T", None, None, True, "", "text")
    assert load_labelled(spark.createDataFrame([good], LABELLED)).count() == 1
    with pytest.raises(InvalidInput, match="duplicate id"):
        load_labelled(spark.createDataFrame([good, good], LABELLED))


def test_profile_settings():
    settings = {
        "titles": {"include": ["a"]}, "keywords": {"strong": ["b"]},
        "location": {"priority": [{"work_modes": ["onsite"], "regions": ["eu"]}], "work_authorization": {"have": ["eu"], "need_sponsorship": ["us"]}},
        "scoring": {"threshold": 70, "max_llm_scores_per_run": 300, "bands": [
            {"low": 50, "high": 100, "meaning": "Core. More."}, {"low": 0, "high": 49, "meaning": "Rest"}]},
    }
    profile = profile_from_settings(settings)
    assert [b.name for b in profile.bands] == ["Core", "Rest"] and profile.prompt_version == 1
    with pytest.raises(ValueError, match="start"):
        profile_from_settings({**settings, "scoring": {**settings["scoring"], "prompt_version": 0}})
    with pytest.raises(ValueError, match="sponsorship"):
        profile_from_settings({**settings, "location": {**settings["location"], "work_authorization": {"have": ["us"], "need_sponsorship": ["us"]}}})
    with pytest.raises(ValueError, match="Unknown section"):
        profile_from_settings({**settings, "title": {}})


def test_digest_document(spark):
    entries = spark.createDataFrame([("priority", 2, "b"), ("priority", 1, "a"), ("acceptable", 1, "c")], "section STRING, position INT, title STRING")
    path = working_folder(spark, "digest")
    write_digest(entries, path)
    assert [r["title"] for r in spark.read.json(f"{path}/section=priority").orderBy("position").collect()] == ["a", "b"]
    assert TABLES["digest_appearances"].startswith("job_key")
