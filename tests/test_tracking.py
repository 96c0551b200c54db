"""The event fold against a one-at-a-time model, and the figures over it."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postflow.functions.scans import last_before
from postflow.operators import tracking as T
from postflow.schemas import TABLES
from postflow.session import cut

T0 = datetime(2026, 1, 1)
LOG = "job_key STRING, action STRING, occurred_at TIMESTAMP, seq BIGINT, notes STRING"


def at(hours):
    return T0 + timedelta(hours=hours)


class Tracker:
    """One entry at a time, for comparison."""

    def __init__(self, applications):
        self.apps = {k: {"status": s, "applied_at": a, "created_at": c} for k, s, a, c in applications}
        self.events, self.outcomes = [], {}

    def act(self, job, action, when, seq, notes):
        app = self.apps.get(job)
        status = app["status"] if app else None
        sent = status not in (None, "interested", "dismissed")
        if action == "apply":
            if sent:
                return False
            app = self.apps.setdefault(job, {"created_at": when})
            app.update(status="applied", applied_at=when)
            if not any(e[:2] == (job, "applied") for e in self.events):
                self.events.append((job, "applied", when, None, seq))
            return True
        if action == "dismiss":
            if sent or status == "dismissed":
                return False
            self.apps.setdefault(job, {"created_at": when, "applied_at": None})["status"] = "dismissed"
            return True
        if action == "undismiss":
            if status != "dismissed":
                return False
            del self.apps[job]
            return True
        if action not in T.EVENT_KINDS or app is None or status == "dismissed":
            return False
        same = [e for e in self.events if e[:2] == (job, action)]
        if action in T.REPEATABLE_EVENTS:
            same = [e for e in same if e[2].date() == when.date()]
        if same and action != "note":
            return False
        self.events.append((job, action, when, notes, seq))
        if action != "note":
            app["status"] = T.EVENT_STATUS[action]
            if action == "applied" and app["applied_at"] is None:
                app["applied_at"] = when
        return True


def test_fold_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    jobs = [f"j{i}" for i in range(40)]
    stored = [(j, rng.choice(["interested", "dismissed"]), None, at(-50)) for j in jobs[:20]]
    actions = [*T.ACTIONS, *T.ACTIONS, *T.EVENT_KINDS, "note", "unknown_step", "draft_cv"]
    log = [
        (rng.choice(jobs), rng.choice(actions), at(rng.randrange(96)), seq, rng.choice([None, " ", "text"]))
        for seq in range(900)
    ]
    model = Tracker(stored)
    for job, action, when, seq, notes in log:
        model.outcomes[seq] = model.act(job, action, when, seq, (notes or "").strip() or None)
    apps = spark.createDataFrame(stored, TABLES["applications"])
    for stretch in (65_536, 50):
        fold = T.fold_events(spark.createDataFrame(log, LOG), apps, stretch=stretch)
        assert {r["seq"]: r["changed"] for r in fold.outcomes.collect()} == model.outcomes
        assert {tuple(r) for r in fold.events.select("job_key", "event", "occurred_at", "notes", "seq").collect()} == set(model.events)
        got = {r["job_key"]: (r["status"], r["applied_at"], r["created_at"]) for r in fold.applications.collect()}
        assert got == {k: (a["status"], a["applied_at"], a["created_at"]) for k, a in model.apps.items()}
    # Two halves, the second on top of the first, come to the same.
    half = spark.createDataFrame(log[:450], LOG), spark.createDataFrame(log[450:], LOG)
    first = T.fold_events(half[0], apps)
    second = T.fold_events(half[1], cut(first.applications), cut(first.events))
    assert {tuple(r)[:5] for r in second.events.collect()} == set(model.events)
    assert {r["job_key"]: r["status"] for r in second.applications.collect()} == {k: a["status"] for k, a in model.apps.items()}


def test_can_act_agrees_with_the_fold(spark):
    cards = spark.createDataFrame([(s or "none", s) for s in [None, "interested", "dismissed", "applied", "offer"]],
                                  "job_key STRING, status STRING")
    apps = cards.where("status IS NOT NULL").select(
        "job_key", "status", F.lit(None).cast("timestamp").alias("applied_at"), F.lit(None).cast("timestamp").alias("created_at"))
    for action in T.ACTIONS:
        log = cards.select("job_key", F.lit(action).alias("action"), F.lit(T0).alias("occurred_at"),
                           F.lit(1).alias("seq"), F.lit(None).cast("string").alias("notes"))
        done = {r["job_key"]: r["changed"] for r in T.fold_events(log, apps).outcomes.collect()}
        said = {r["job_key"]: r["allowed"] for r in T.can_act(cards, action).collect()}
        assert done == said


def test_last_before(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, str(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g STRING, seq BIGINT, v STRING")
    got = {r["seq"]: r["p"] for r in last_before(df, "g", "seq", F.col("v"), "p", stretch=16).collect()}
    last = {}
    for g, seq, v in rows:
        assert got[seq] == last.get(g)
        last[g] = v or last.get(g)


def test_figures(spark):
    apps = spark.createDataFrame([
        ("a", "in_process", at(0), at(0)), ("b", "rejected", None, at(1)), ("c", "interested", None, at(2)),
        ("d", "dismissed", None, at(3)), ("e", "applied", at(4), at(4)),
    ], TABLES["applications"])
    events = spark.createDataFrame([
        ("a", "applied", at(0), None, 1), ("a", "technical", at(30), None, 2), ("a", "technical", at(60), None, 3),
        ("b", "applied", at(1), None, 4), ("b", "rejected", at(9), None, 5), ("d", "note", at(3), "x", 6),
        ("c", "ghosted", at(3), None, 7),
    ], TABLES["application_events"])
    facts = T.application_facts(apps, events)
    assert {r["job_key"]: (r["sent"], r["responded"], r["standing"]) for r in facts.collect()} == {
        "a": (True, True, "in process"), "b": (True, True, "rejected"), "c": (False, False, None), "e": (True, False, None)}
    assert [(r["status"], r["applications"]) for r in T.pipeline(apps).collect()] == [
        ("interested", 1), ("applied", 1), ("in_process", 1), ("rejected", 1)]
    assert [(r["stage"], r["reached"], round(r["share_of_sent"], 3)) for r in T.funnel(facts).collect()] == [
        ("recruiter_screen", 0, 0.0), ("technical", 1, 0.333), ("onsite", 0, 0.0), ("offer", 0, 0.0)]
    assert [(r["stage"], r["reached"]) for r in T.funnel(facts, T.FUNNEL_ENDINGS).collect()] == [
        ("rejected", 1), ("ghosted", 1), ("withdrawn", 0)]
    sliced = facts.withColumn("source", F.when(F.col("job_key") == "e", F.lit("hn")).otherwise(F.lit("lever"))).withColumn("tier", F.lit("lab"))
    assert [(r["slice"], r["label"], r["applied"], r["responded"]) for r in T.response_rates(sliced, ["source", "tier"]).collect()] == [
        ("all", None, 3, 2), ("source", "lever", 2, 2), ("source", "hn", 1, 0), ("tier", "lab", 3, 2)]
    assert T.funnel(facts.limit(0)).collect()[0]["share_of_sent"] == 0.0
    last = {r["job_key"]: (r["last_event"]["event"], r["events"]) for r in T.last_events(events).collect()}
    assert last["a"] == ("technical", 3) and last["b"] == ("rejected", 2)


def test_primary_source_and_cards(spark):
    jobs = spark.createDataFrame([
        {"job_key": "a", "title": "T", "company_slug": "acme", "primary_source": "lever", "primary_source_job_id": "2", "apply_url": "own"},
        {"job_key": "b", "title": "T", "company_slug": "acme"}, {"job_key": "c", "title": "T", "company_slug": "acme"}], TABLES["jobs"])
    postings = spark.createDataFrame([("a", "ashby", "1", at(0)), ("a", "lever", "2", at(1)), ("b", "hn", "3", at(1)), ("b", "ashby", "4", at(2))],
                                     "job_key STRING, source STRING, source_job_id STRING, first_seen TIMESTAMP")
    assert {r["job_key"]: r["source"] for r in T.primary_sources(jobs, postings).collect()} == {"a": "lever", "b": "hn", "c": "unknown"}
    companies = spark.createDataFrame([{"slug": "acme", "name": "Acme", "tier": "lab"}], TABLES["companies"])
    apps = spark.createDataFrame([("b", "interested", None, at(0)), ("c", "applied", at(1), at(1))], TABLES["applications"])
    best = spark.createDataFrame([("a", 80, " s ", "won")], "job_key STRING, score INT, summary STRING, url STRING")
    cards = {r["job_key"]: r for r in T.job_cards(jobs, companies, apps, best).collect()}
    assert (cards["a"]["apply_url"], cards["a"]["summary"], cards["a"]["location"], cards["a"]["settled"]) == ("won", "s", "not stated", False)
    assert cards["b"]["settled"] is False and cards["c"]["settled"] is True
    facts = T.application_facts(apps, spark.createDataFrame([], TABLES["application_events"]))
    tracked = T.tracked_applications(facts, spark.createDataFrame([], TABLES["application_events"]), jobs, companies, postings).collect()
    assert [(r["job_key"], r["source"], r["ended"]) for r in tracked] == [("c", "unknown", False), ("b", "hn", False)]
    T.publish_views(job_cards=T.job_cards(jobs, companies, apps, best))
    assert spark.sql("SELECT count(*) FROM job_cards WHERE score >= 80").first()[0] == 1
