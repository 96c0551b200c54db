"""Readers: what they take from a payload, and what fails a board."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from postflow.functions.times import local_day, noon_of, parse_iso_datetime
from postflow.operators.quality import check_schema, check_tables
from postflow.schemas import LANDED, POSTING, TABLES, struct_of
from postflow.sources import readers as R

NOW = datetime(2026, 1, 1)


def landed(spark, source, *bodies):
    rows = [(source, f"c{i}", NOW, code, body if body is None or isinstance(body, str) else json.dumps(body))
            for i, (code, body) in enumerate(bodies)]
    return spark.createDataFrame(rows, LANDED)


def read(spark, source, *bodies):
    postings, runs = R.read_source(landed(spark, source, *bodies), source)
    assert not check_schema(postings.select(*struct_of(POSTING).fieldNames()), struct_of(POSTING))
    return ([r.asDict() for r in postings.orderBy("company_slug", "position").collect()],
            {r["company_slug"]: (r["status"], r["item_count"], r["error"]) for r in runs.collect()})


def test_greenhouse(spark):
    good = {"jobs": [
        {"id": 1, "title": "T", "absolute_url": "u", "location": {"name": "Lisbon"}, "offices": [{"name": "Lisbon HQ"}, {"name": ""}, {"name": None}],
         "content": "&lt;p&gt;A &amp;amp; B&lt;/p&gt;", "first_published": "", "updated_at": "2024-05-01T10:00:00+02:00", "extra": {"z": 1, "a": None}},
        {"id": "2", "title": "U", "location": None, "updated_at": "soon"}], "meta": {"total": 2}}
    postings, runs = read(
        spark, "greenhouse", (200, good), (200, {"jobs": []}), (404, {"jobs": []}), (200, "<html>"), (200, {"total": 0}),
        (200, {"jobs": [{"id": 1, "title": "ok"}, {"id": 2}]}), (200, {"jobs": ["text"]}), (None, None), (200, {"jobs": {"a": 1}}), (200, []))
    first, second = postings
    assert (first["source_job_id"], first["location_raw"], first["location_hints"], first["description"]) == ("1", "Lisbon", ["Lisbon HQ"], "A & B")
    assert first["posted_at"] == datetime(2024, 5, 1, 8) and second["posted_at"] is None and second["description"] == ""
    assert json.loads(first["raw"])["extra"] == {"z": 1, "a": None}
    assert runs["c0"] == ("ok", 2, None) and runs["c1"] == ("ok", 0, None)
    assert [runs[f"c{i}"][0] for i in range(2, 10)] == ["failed"] * 8
    assert runs["c2"][2] == "HTTP 404" and runs["c3"][2] == "Non-JSON response" and "lacks id or title" in runs["c5"][2]


def test_lever(spark):
    body = [{"id": "x", "text": "T", "hostedUrl": "h", "categories": {"location": "Paris", "allLocations": ["Paris", "Berlin"]},
             "descriptionPlain": "Intro", "lists": [{"text": "Duties", "content": "<li>a</li><li>b &amp; c</li>"}, {"content": "<p>more"}],
             "additionalPlain": "End ", "country": "FR", "workplaceType": "hybrid", "createdAt": 1714550400123}]
    postings, runs = read(spark, "lever", (200, body), (200, {"jobs": []}))
    p = postings[0]
    assert p["description"] == "Intro\n\nDuties\n- a\n\n- b & c\n\nmore\n\nEnd"
    assert (p["location_hints"], p["country_code"], p["workplace_type"]) == (["Berlin"], "FR", "hybrid")
    assert p["posted_at"] == datetime(2024, 5, 1, 8, 0, 0, 123000) and runs["c1"][0] == "failed"


def test_ashby(spark):
    jobs = [
        {"id": "1", "title": "T", "jobUrl": "", "applyUrl": "apply", "location": "Lisbon", "secondaryLocations": [{"location": "Porto"}, {"location": ""}],
         "address": {"postalAddress": {"addressCountry": "Portugal"}}, "descriptionPlain": " text ", "workplaceType": "Hybrid", "isRemote": True},
        {"id": "2", "title": "U", "isListed": False}, {"title": "unlisted, without id", "isListed": False}, {"id": "3", "title": "V", "isListed": None}]
    postings, runs = read(spark, "ashby", (200, {"jobs": jobs}))
    assert len(postings) == 1 and runs["c0"] == ("ok", 1, None)
    p = postings[0]
    assert (p["url"], p["location_hints"], p["description"], p["is_remote"]) == ("apply", ["Porto", "Portugal"], "text", True)


def test_aggregators(spark):
    ok = [{"legal": "notice"}, {"id": "9", "position": "T", "company": " ", "location": "", "description": "&lt;b&gt;x&lt;/b&gt;", "date": "2024-05-01T08:00:00"}, {"id": 0, "position": "no"}]
    postings, runs = read(spark, "remoteok", (200, ok), (200, {"jobs": []}))
    assert [(p["source_job_id"], p["company_name"], p["location_raw"], p["description"], p["is_remote"]) for p in postings] == [("9", None, None, "x", True)]
    assert runs["c1"][0] == "failed"
    postings, _ = read(spark, "arbeitnow", (200, {"data": [{"slug": "s", "title": "T", "company_name": "A ", "remote": False, "created_at": 1714550400}]}))
    assert (postings[0]["company_name"], postings[0]["is_remote"], postings[0]["posted_at"]) == ("A", False, datetime(2024, 5, 1, 8))
    postings, _ = read(spark, "remotive", (200, {"jobs": [{"id": 5, "title": "T", "publication_date": "2024-05-01T08:00:00", "description": "<p>a<p>b"}]}))
    assert (postings[0]["posted_at"], postings[0]["description"]) == (datetime(2024, 5, 1, 8), "a\nb")


def test_hn_thread(spark):
    search = landed(spark, "hn_search", (200, {"hits": [{"objectID": "1", "title": "Ask HN: Who wants to be hired?"},
                                                        {"objectID": "2", "title": "Ask HN: Who is hiring? (May)"}, {"objectID": "3", "title": "Ask HN: Who is hiring? (April)"}]}))
    long = "Acme | " + "x" * 400
    thread = {"id": 2, "children": [{"id": 20, "text": f"{long}<p>body", "children": [{"id": 21, "text": "reply"}]}, {"id": 22, "text": None}]}
    threads = landed(spark, "hn", (200, thread), (200, {"id": 3, "children": []}))
    boards = R.thread_boards(search, threads)
    postings, runs = R.read_source(boards, "hn")
    p = postings.first()
    assert postings.count() == 1 and p["title"] == long and "children" not in json.loads(p["raw"])
    assert p["url"].endswith("?id=20") and p["company_name"] is None and runs.first()["status"] == "ok"
    missing = R.thread_boards(landed(spark, "hn_search", (200, {"hits": []})), threads)
    assert R.read_source(missing, "hn")[1].first()["status"] == "failed"


def test_replay_and_unknown_sources(spark):
    rows = landed(spark, "greenhouse", (200, {"jobs": [{"id": 1, "title": "T", "content": "x"}]})).unionByName(landed(spark, "workday", (200, {})))
    postings, runs = R.read_sources(rows)
    again = R.replay(postings.select("source", "raw", "company_slug"))
    assert [(r["source_job_id"], r["title"], r["description"]) for r in again.collect()] == [("1", "T", "x")]
    assert {r["source"]: r["status"] for r in runs.collect()} == {"greenhouse": "ok", "workday": "failed"}


def test_times(spark):
    texts = ["2024-05-01T08:00:00Z", "2024-05-01T10:00:00+02:00", "2024-05-01T08:00:00", "junk", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r["v"] for r in df.orderBy("i").select(parse_iso_datetime(F.col("t")).alias("v")).collect()]
    assert got == [datetime(2024, 5, 1, 8)] * 3 + [None] * 3
    row = spark.createDataFrame([(datetime(2024, 7, 1, 23, 30),)], "t TIMESTAMP").select(
        local_day(F.col("t"), "Europe/Lisbon").alias("d"), noon_of(F.lit("2024-07-01").cast("date"), "Europe/Lisbon").alias("n")).first()
    assert str(row["d"]) == "2024-07-02" and row["n"] == datetime(2024, 7, 1, 11)


def test_schema_checks(spark):
    df = spark.createDataFrame([], "job_key STRING, status INT")
    assert check_tables({"applications": df}, {"applications": TABLES["applications"], "jobs": TABLES["jobs"]}) == {
        "applications": ["column status is int, declared string", "missing column applied_at", "missing column created_at"],
        "jobs": ["missing table"]}
