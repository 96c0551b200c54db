"""Opening resolution against a one-at-a-time model, and merging."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from postflow.functions import segments
from postflow.functions.similarity import indel_similarity
from postflow.operators import resolve as R
from postflow.schemas import TABLES

T0 = datetime(2026, 1, 1)
POSTINGS = "source STRING, source_job_id STRING, job_key STRING, first_seen TIMESTAMP, company STRING, title STRING, region STRING"
JOBS = "job_key STRING, canonical_key STRING, company STRING, title STRING, region STRING, first_seen TIMESTAMP"


def at(n):
    return T0 + timedelta(minutes=n)


def words(title):
    return " ".join(sorted(title.split()))


def random_titles(seed, n):
    rng = random.Random(seed)
    stems = ["research scientist alignment", "software engineer inference platform", "member of technical staff",
             "machine learning engineer post training", "ai"]
    out = []
    for _ in range(n):
        letters = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            spot = rng.randrange(len(letters))
            if rng.random() < 0.5:
                letters.insert(spot, rng.choice("abe"))
            elif letters[spot] != " ":
                del letters[spot]
        parts = "".join(letters).split()
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out


def test_similar_titles_is_exact(spark):
    titles = sorted({words(t) for t in random_titles(1, 120)})
    rows = [(str(i), f"b{i % 2}", t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "node STRING, block STRING, text STRING")
    expected = {
        (i, j) for i, bi, a in rows for j, bj, b in rows
        if i != j and bi == bj and indel_similarity(a, b) >= 95
    }
    assert len(expected) > 20
    assert {(r["node"], r["other"]) for r in R.similar_titles(df, df).collect()} == expected
    some = df.where(F.col("node").cast("int") % 3 == 0)
    got = {(r["node"], r["other"]) for r in R.similar_titles(df, some).collect()}
    assert got == {(i, j) for i, j in expected if int(j) % 3 == 0}


def test_batches_do_not_change_who_founds(spark, monkeypatch):
    titles = sorted({words(t) for t in random_titles(3, 150)}, key=lambda t: hash(t) % 97)
    df = spark.createDataFrame([(str(i), "b", t, i) for i, t in enumerate(titles)], "node STRING, block STRING, text STRING, at INT")
    expected = []
    for i, t in enumerate(titles):
        if all(indel_similarity(t, titles[j]) < 95 for j in expected):
            expected.append(i)
    for first, last in ((64, 2048), (1, 4), (7, 7)):
        monkeypatch.setattr(R, "FIRST_BATCH", first)
        monkeypatch.setattr(R, "LAST_BATCH", last)
        assert sorted(int(r["node"]) for r in R.job_founders(df).collect()) == expected


def test_a_company_of_many_near_equal_titles(spark):
    stem = "principal platform engineer for reliable distributed storage and streaming number"
    rows = [(f"{i:04}", "b", f"{i:04} {stem}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "node STRING, block STRING, text STRING, at INT")
    assert [r["node"] for r in R.job_founders(df).collect()] == ["0000"]
    plan = R.similar_titles(df, df.limit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "block" in plan


def one_at_a_time(titles):
    """Each title joins the most alike earlier founder, first among equals, or founds."""
    founders, out = [], []
    for i, title in enumerate(titles):
        best, score = None, 0.0
        for f in founders:
            s = 101.0 if titles[f] == title else indel_similarity(words(titles[f]), words(title))
            if s >= 95 and s > score:
                best, score = f, s
        out.append(i if best is None else best)
        if best is None:
            founders.append(i)
    return out


def edited(rnd, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(letters) + 1)
        if letters and rnd.random() < 0.5:
            letters.pop(min(at, len(letters) - 1))
        else:
            letters.insert(at, rnd.choice("abcde "))
    return "".join(letters)


def test_segments_miss_no_like_pair():
    rnd = random.Random(4)
    for _ in range(3000):
        one = "".join(rnd.choice("abcde ") for _ in range(rnd.choice([1, 5, 19, 20, 21, 40, 70, 130])))
        two = edited(rnd, one, rnd.randrange(1 + len(one) // 8 + 1))
        for threshold in (90, 95, 99):
            if one and two and indel_similarity(one, two) >= threshold:
                assert set(segments.entries(one, threshold)) & set(segments.probes(two, threshold))


def test_native_segments_are_the_same(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc ") for _ in range(n)) for n in (*range(1, 45), 70, 130)]
    df = spark.createDataFrame([("b", t) for t in texts], "block string, text string")
    found = df.select("text", segments.entry_keys(F.col("block"), F.col("text"), 95).alias("e"),
                      segments.probe_keys(F.col("block"), F.col("text"), 95).alias("p"))
    every = {e for t in texts for e in (*segments.entries(t, 95), *segments.probes(t, 95))}
    keys = spark.createDataFrame(list(every), "l int, i int, s string").select("l", "i", "s", F.xxhash64(F.lit("b"), "l", "i", "s").alias("k"))
    named = {(r["l"], r["i"], r["s"]): r["k"] for r in keys.collect()}
    for r in found.collect():
        assert r["e"] == [named[e] for e in segments.entries(r["text"], 95)]
        assert r["p"] == [named[e] for e in segments.probes(r["text"], 95)]


def unlike(rnd, n):
    return [" ".join(sorted("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4))) for _ in range(n)]


def test_unlike_founders_are_not_offered(spark):
    rnd = random.Random(6)
    wanted = unlike(rnd, 50)

    def frame(texts, mark):
        return spark.createDataFrame([(f"{mark}{i}", "acme", t) for i, t in enumerate(texts)], "node string, block string, text string")

    titles = frame([edited(rnd, t, 1) for t in wanted], "t")
    few = R.offered_pairs(titles, frame(wanted + unlike(rnd, 100), "f")).count()
    many = R.offered_pairs(titles, frame(wanted + unlike(rnd, 10_000), "f")).count()
    assert 50 <= few <= many <= 60


def test_a_company_of_many_unlike_titles(spark):
    texts = unlike(random.Random(7), 50_000)
    titles = spark.createDataFrame(
        [(f"n{i}", "acme", t, i) for i, t in enumerate(texts)], "node string, block string, text string, at long")
    assert R.job_founders(titles).count() == len(texts)


def test_resolution_equals_the_sequential_rule(spark):
    titles = random_titles(7, 60)
    rows = [("gh", f"{i:03}", None, at(i), "Acme", t, "us") for i, t in enumerate(titles)]
    result = R.resolve_openings(spark.createDataFrame(rows, POSTINGS), spark.createDataFrame([], JOBS))
    key = {r["source_job_id"]: r["job_key"] for r in result.created.collect()}
    expected = one_at_a_time(titles)
    assert set(key) == {f"{i:03}" for i in set(expected)}
    got = {r["source_job_id"]: r["job_key"] for r in result.assignments.collect()}
    assert got == {f"{i:03}": key[f"{e:03}"] for i, e in enumerate(expected)}


def jobs_of(spark, *rows):
    """(job, title, minute) -> stored jobs with the key their title gives them."""
    df = spark.createDataFrame([(k, "Acme", t, "portugal", at(m)) for k, t, m in rows],
                               "job_key STRING, company STRING, title STRING, region STRING, first_seen TIMESTAMP")
    return R.with_identity(df).select("job_key", "canonical_key", "company", "title", "region", "first_seen")


def arrivals(spark, *rows):
    return spark.createDataFrame([("gh", p, j, at(m), c, t, r) for p, j, m, c, t, r in rows], POSTINGS)


def test_known_postings(spark):
    jobs = jobs_of(spark, ("j1", "Research Scientist, Evals", 0), ("j2", "Research Scientist, Post-Training", 1),
                   ("j3", "Research Engineer", 2))
    postings = arrivals(
        spark,
        ("a", "j1", 0, "Acme", "Research Scientist, Post-Training", "portugal"),  # lands on j2
        ("b", "j2", 1, "Acme", "Post-Training Research Scientist", "portugal"),  # reads the same
        ("c", "j3", 2, "Acme", "Senior Research Engineer", "portugal"),  # renamed
        ("d", None, 3, "ACME", "Senior Research Engineer (Remote)", "portugal"),  # joins the renamed one
        ("e", None, 4, "Acme", "Research Scientist, Evals", "us"),  # another region
        ("f", None, 5, "Acme", "Evals Research Scientist", "portugal"),  # reordered words
    )
    result = R.resolve_openings(postings, jobs)
    got = {r["source_job_id"]: (r["job_key"], r["action"]) for r in result.assignments.collect()}
    assert got["a"] == ("j1", "merge") and got["b"] == ("j2", "keep") and got["c"] == ("j3", "rename")
    assert got["d"] == ("j3", "attach") and got["e"][1] == "create" and got["f"] == ("j1", "attach")
    assert [(r["kept_from"], r["merged_into"]) for r in result.merges.collect()] == [("j1", "j2")]
    renamed = result.renamed.collect()
    assert [r["job_key"] for r in renamed] == ["j3"]


def stored_jobs(spark, rows):
    full = [{"job_key": k, "canonical_key": f"k-{k}", "first_seen": at(m), "posted_at": p, "primary_source": s, "primary_source_job_id": s}
            for k, m, p, s in rows]
    return spark.createDataFrame(full, TABLES["jobs"])


def test_merge(spark):
    jobs = stored_jobs(spark, [("a", 0, at(9), None), ("b", 1, at(5), "pb"), ("c", 2, None, "pc"), ("d", 3, None, None),
                               ("x", 0, None, None), ("y", 1, None, None), ("m", 5, None, None)])
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "m")], "kept_from STRING, merged_into STRING")
    apps = spark.createDataFrame([("x", "applied", None, None), ("m", "applied", None, None), ("b", "dismissed", None, None)], TABLES["applications"])
    scored = spark.createDataFrame([("c",)], "job_key STRING")
    postings = spark.createDataFrame([("a", "p1"), ("c", "p2"), ("d", "p3"), ("y", "p4")], "job_key STRING, source_job_id STRING")
    day = date(2026, 1, 1)
    shown = spark.createDataFrame([("a", day, "priority", 1, 70, "h"), ("b", day, "priority", 2, 71, "h"),
                                   ("c", date(2026, 1, 2), "priority", 1, 72, "h")], TABLES["digest_appearances"])
    plan = R.survivors(pairs, R.ranked_jobs(jobs, apps, scored))
    out = R.merge_openings(plan, jobs, postings, apps, shown)
    rows = {r["job_key"]: r for r in out.jobs.collect()}
    assert set(rows) == {"b", "d", "x", "m"}
    assert rows["b"]["posted_at"] == at(5) and rows["b"]["primary_source"] == "pb"
    assert {r["source_job_id"]: r["job_key"] for r in out.postings.collect()} == {"p1": "b", "p2": "b", "p3": "d", "p4": "x"}
    assert sorted(r["job_key"] for r in out.applications.collect()) == ["b", "m", "x"]
    assert sorted((r["job_key"], r["digest_date"].day, r["score_at_appearance"]) for r in out.appearances.collect()) == [("b", 1, 71), ("b", 2, 72)]


def test_survivor_order(spark):
    pairs = spark.createDataFrame([("a", "b")], "kept_from STRING, merged_into STRING")
    none = spark.createDataFrame([], TABLES["applications"])
    unscored = spark.createDataFrame([], "job_key STRING")

    def winner(jobs, apps=none, scored=unscored):
        got = R.survivors(pairs, R.ranked_jobs(jobs, apps, scored)).collect()
        assert len({r["survivor"] for r in got}) == 1
        return got[0]["survivor"]

    jobs = stored_jobs(spark, [("a", 5, None, None), ("b", 1, None, None)])
    assert winner(jobs) == "b"
    assert winner(jobs, scored=spark.createDataFrame([("a",)], "job_key STRING")) == "a"
    assert winner(stored_jobs(spark, [("a", 1, None, None), ("b", 1, None, None)])) == "a"


def test_keys_are_taken_only_when_free(spark):
    jobs = stored_jobs(spark, [("a", 0, None, None), ("b", 1, None, None), ("c", 2, None, None)])
    wanted = spark.createDataFrame([("a", "k-b"), ("b", "fresh"), ("c", "fresh")], "job_key STRING, canonical_key STRING")
    got = {r["job_key"]: r["canonical_key"] for r in R.retaken_keys(jobs, wanted).collect()}
    assert got == {"a": "k-a", "b": "fresh", "c": "k-c"}
