"""Toxicity, quality, language and decontamination."""

import random

import numpy as np
import pytest
from llm_cases import SF, documents, empty, given, labels, rows_of
from pyspark.sql import functions as F

from postflow.llm import decontaminate as D, language_id as L, quality as Q, toxicity as T
from postflow.llm.queries import QUERIES

MID = "/root/testdata/sf0.1"


# --- toxicity ---

def made_up(rnd, toxic):
    words = [f"w{rnd.randint(0, 200)}" for _ in range(rnd.randint(5, 120))]
    if toxic:
        words[rnd.randrange(len(words))] = rnd.choice(["badword", "badwordly", "vile"])
    return " ".join(w + rnd.choice(["", "", "", "."]) for w in words)


def test_sentences_and_scores():
    model = T.Model({T.keys_of("vile")[0]: 12.0}, bias=-8.0, leak=0.01)
    scorer = T.Scorer(model)
    text = "A fine day. You VILE thing!\nAnd on it goes\n \n."
    score, number, offending = scorer.score(text)
    assert number == 3 and [text[a:b] for a, b in offending] == [" You VILE thing"]
    clean = 2 * np.logaddexp(0, -8.0) + 0.01
    assert score == pytest.approx(1 - np.exp(-clean - np.logaddexp(0, 4.0)))
    assert scorer.score("")[0] == pytest.approx(1 - np.exp(-0.01)) and scorer.score("servile, revile")[2] == []
    assert T.Scorer(T.Model()).score("vile. " * 1000)[0] < 1e-8


def test_learning_finds_the_sentence_behind_the_label(spark):
    rnd = random.Random(1)
    rows = [(k, made_up(rnd, k % 5 == 0), "en") for k in range(2000)]
    marks = labels(spark, [(k, 1, int(k % 5 == 0)) for k in range(2000)])
    docs = documents(spark, rows)
    model = T.train(docs, marks)
    scores = {r["doc_id"]: r for r in T.score_documents(docs, spark.sparkContext.broadcast(model)).collect()}
    assert all((scores[k]["score"] >= T.THRESHOLD) == (k % 5 == 0) for k in range(2000))
    for k in range(0, 2000, 5):
        assert [("bad" in rows[k][1][s["start"]:s["end"]] or "vile" in rows[k][1][s["start"]:s["end"]]) for s in scores[k]["offending"]] == [True]
    kept = T.kept_documents(docs, marks)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == rows_of(docs.where("doc_id % 5 != 0"), "doc_id")


def test_held_out_labels_are_not_learned_from(spark):
    docs = documents(spark, [(k, f"vile{k % 2} thing", "en") for k in range(400)])
    marks = labels(spark, [(k, 1, k % 2) for k in range(400)])
    rows, _ = T.sample(docs, marks.where(T.held_out()))
    assert rows.count() == 0


def test_toxicity_edge_rows(spark):
    docs, marks = documents(spark), labels(spark, [(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (5, 1, 0)])
    model = spark.sparkContext.broadcast(T.train(docs, marks))
    assert T.score_documents(docs, model).where("score >= 0 AND score <= 1").count() == docs.count()
    assert T.train(docs, labels(spark, [])) == T.Model()
    assert T.score_documents(empty(spark), model).collect() == []
    assert T.train(empty(spark), marks) == T.Model()


def test_toxicity_on_held_out_labels(spark):
    found = QUERIES["op4_toxicity"](spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out")
    count = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert count[1, 1] >= 0.85 * (count[1, 1] + count[1, 0])
    assert count[0, 0] >= 0.99 * (count[0, 0] + count.get((0, 1), 0))


# --- quality ---

def test_buckets():
    assert len(Q.buckets("", Q.WordHashes())) == 0 and len(Q.buckets("a B  a\n", Q.WordHashes())) == 5
    assert Q.buckets("x y", Q.WordHashes())[0] == Q.buckets("X", Q.WordHashes())[0]


def test_counts_cover_every_text(spark):
    docs = given("documents")
    hashes, expected = Q.WordHashes(), np.zeros(Q.BUCKETS, np.int64)
    for text in docs.text:
        expected += np.bincount(Q.buckets(text, hashes), minlength=Q.BUCKETS)
    assert np.array_equal(Q.count_buckets(spark.read.parquet(f"{SF}/documents.parquet")), expected)


def test_draw_takes_the_largest_keys(spark):
    ratio = spark.sparkContext.broadcast(np.random.RandomState(0).randn(Q.BUCKETS))
    docs = documents(spark)
    found = Q.resample(docs, ratio, 0.4).collect()
    ranked = sorted(found, key=lambda r: (-r["gumbel_key"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert sorted(r["rank"] for r in found) == list(range(1, len(found) + 1))
    assert [r["rank"] for r in ranked] == sorted(r["rank"] for r in found)
    assert sum(r["sampled"] for r in found) == 4 and all(r["sampled"] == (r["rank"] <= 4) for r in found)
    assert all(r["log_weight"] == 0 for r in found if r["doc_id"] in (2, 3, 4))
    assert Q.resample(empty(spark), ratio, 0.4).collect() == []
    # Ties: the noise of a repeated row is its own's, so equal rows stand side by side.
    assert sorted(r["rank"] for r in found if r["doc_id"] == 6)[1] - sorted(r["rank"] for r in found if r["doc_id"] == 6)[0] == 1


def test_noise_draws_in_proportion_to_the_weights(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    keys = np.array([r["gumbel_key"] for r in Q.weigh(docs, spark.sparkContext.broadcast(np.zeros(Q.BUCKETS))).collect()])
    assert abs(keys.mean() - 0.5772) < 0.03 and abs(keys.std() - 1.2825) < 0.03


def test_models_coincide_without_good_labels(spark):
    ratio, share = Q.train(documents(spark), labels(spark, []))
    assert not ratio.any() and share == 1.0


def test_quality_on_held_out_labels(spark):
    docs, marks = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    found = QUERIES["op7_quality"](spark, MID).join(marks, "doc_id").where(Q.held_out())
    count = {(r["quality"], r["sampled"]): r["count"] for r in found.groupBy("quality", "sampled").count().collect()}
    assert count[1, True] >= 0.97 * (count[1, True] + count.get((1, False), 0))
    assert count[0, False] >= 0.9 * (count[0, False] + count.get((0, True), 0))


# --- language ---

def test_grams_do_not_depend_on_stretches(monkeypatch):
    text = "".join(random.Random(2).choices("abcdé  ß1", k=2000))
    whole = np.sort(np.concatenate(list(L.stretches(text))))
    monkeypatch.setattr(L, "STRETCH", 97)
    assert np.array_equal(np.sort(np.concatenate(list(L.stretches(text)))), whole)
    assert len(whole) == 2 * 2002 - 3


def test_language_edge_rows(spark):
    docs = documents(spark)
    languages, matrix = L.train(docs)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs.where("doc_id IS NOT NULL"), languages, spark.sparkContext.broadcast(matrix)).collect()}
    assert [found[k] for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert found[7][0] in languages and 0 < found[7][1] <= 1
    languages, matrix = L.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert languages == []
    assert {r["lang_pred"] for r in L.predict(docs, languages, spark.sparkContext.broadcast(matrix)).collect()} == {"und"}
    assert L.predict(empty(spark), ["en"], spark.sparkContext.broadcast(np.zeros((L.BUCKETS, 1)))).collect() == []


def test_counts_against_brute_force(spark):
    rows = [(k, f"abc {'xyz' if k % 2 else 'abd'} {k}", "p" if k % 2 else "q") for k in range(60)]
    docs = documents(spark, rows)
    languages, matrix = L.train(docs)
    learned = {r["doc_id"] for r in docs.where(~L.held_out()).collect()}
    counts = np.ones((L.BUCKETS, 2))
    for k, text, lang in rows:
        for b in np.concatenate(list(L.stretches(text))) if k in learned else ():
            counts[b, languages.index(lang)] += 1
    assert languages == ["p", "q"] and np.allclose(matrix, np.log(counts / counts.sum(axis=0)), atol=1e-5)


def test_language_sample_is_bounded_per_language(spark):
    docs = documents(spark, [(k, "some text", "rare" if k % 100 == 0 else "common") for k in range(4000)])
    sizes = {r["lang"]: r["count"] for r in L.sample(docs, 200).groupBy("lang").count().collect()}
    assert sizes["rare"] > 20 and 120 < sizes["common"] < 300


def test_language_on_held_out_rows(spark):
    found = QUERIES["op10_language_id"](spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out AND lang = lang_pred").count() >= 0.99 * found.where("held_out").count()


# --- decontamination ---

@pytest.mark.parametrize("q", [1, 2, 3, 5, 8, 10, 16])
def test_grams(q):
    codes = np.random.RandomState(q).randint(1, 9, 60).astype(np.uint32)

    def slow(part):
        value = 0
        for c in part:
            value = (value * D._FACTOR + int(c)) % (1 << 32)
        return value

    assert D.grams(codes, q).tolist() == [slow(codes[i : i + q]) for i in range(60 - q + 1)]
    assert len(D.grams(codes[: q - 1], q)) == 0


def distance(piece, text):
    """Edits of the piece against its best place in the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(piece, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(chars))
        chars[at : at + 1] = rnd.choice([["x"], [], [chars[at], "y"]])
    return "".join(chars)


def test_search_against_full_alignment():
    rnd = random.Random(8)
    item = "".join(rnd.choices("abcdefgh ", k=90))
    folded = [int(c) for c in D.fold(item)[0]]
    index = D.Index([(1, item)])
    budget = index.pieces[0][2]
    for n in range(120):
        noise = "".join(rnd.choices("abcdefgh ", k=60))
        text = noise + edited(rnd, item, n % (2 * budget + 2)) + noise[::-1]
        least = distance(folded, [int(c) for c in D.fold(text)[0]])
        found = index.search(text)
        assert bool(found) == (least <= budget)
        assert min((m[3] for m in found), default=least) == least


def test_spans_pieces_and_short_items():
    rnd = random.Random(9)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.randint(0, 99)}" for _ in range(400)]
    long = " ".join(words)
    index = D.Index([(1, long), (2, "Yes, it is"), (3, None), (4, " . "), (5, " ".join(words[:30]))])
    host = "before. " + " ".join(words[100:260]).upper().replace(" ", " -- ") + " after"
    assert {m[0] for m in index.search(host)} == {1}
    assert index.search(" YES it is!") == [(2, 1, 10, 0)]
    assert index.search("Oh yes it is so") == [(2, 3, 12, 0)] and index.search("yes it isn, eyes it is, yes it, is") == [(2, 24, 34, 0)]
    twins = D.Index([(7, "yes"), (8, "Yes!"), (9, "it is")])
    assert twins.search("yes? it is. Yes") == [(7, 0, 3, 0), (8, 0, 3, 0), (9, 5, 10, 0), (7, 12, 15, 0), (8, 12, 15, 0)]
    assert twins.search("") == twins.search(" . ") == twins.search("yesterday") == []
    text = "Say: " + " ".join(words[:30]) + "; and no more"
    assert (5, 5, 5 + len(" ".join(words[:30])), 0) in index.search(text)


def test_stretches_of_a_long_text(monkeypatch):
    rnd = random.Random(10)
    item = "".join(rnd.choices("abcdefghijkl", k=120))
    index = D.Index([(1, item)])
    monkeypatch.setattr(D, "STRETCH", 300)
    noise = "".join(rnd.choices("mnopqrstuv", k=5000))
    for at in range(0, 1000, 37):
        assert index.search(noise[:at] + item + noise[at:]) == [(1, at, at + 120, 0)]


def test_decontamination_edge_rows(spark):
    item = "this is a benchmark item that is long enough to say something about a text"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (None, ""), (4, "a text")], "item_id long, text string")
    rows = [(1, f"So {item.upper()}!", "x"), (2, None, "x"), (3, "", "x"), (None, item, "x"), (5, "A text?", "x"), (6, "clean " * 50_000, "x")]
    docs = documents(spark, rows + rows[:1])
    assert rows_of(D.matches(docs, bench), "doc_id", "item_id", "edits") == sorted(
        [(1, 1, 0), (1, 2, 0), (1, 4, 0)] * 2 + [(None, 1, 0), (None, 2, 0), (None, 4, 0), (5, 4, 0)], key=repr
    )
    assert rows_of(D.kept_documents(docs, bench), "doc_id") == [(2,), (3,), (6,)]
    assert D.kept_documents(docs, bench).columns == docs.columns
    assert D.matches(empty(spark), bench).collect() == [] and D.matches(docs, bench.limit(0)).collect() == []


def test_blocks_give_what_one_block_gives(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    parts = [items.value for items in D.blocks(bench, 2000)]
    assert len(parts) > 2 and sorted(i for part in parts for i, _ in part) == sorted(given("benchmark").item_id)


def test_decontamination_query_against_containment(spark):
    def folded(text):
        return "".join(c.lower() for c in text if c.isalnum())

    docs, bench = given("documents", MID), given("benchmark", MID)
    items = [(i, folded(t)) for i, t in zip(bench.item_id.tolist(), bench.text)]
    expected = {(k, i) for k, t in zip(docs.doc_id.tolist(), map(folded, docs.text)) for i, x in items if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_decontaminate"](spark, MID).where("edits = 0").collect()}
    assert expected and found == expected
