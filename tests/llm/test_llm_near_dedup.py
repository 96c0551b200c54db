import random

import numpy as np
from llm_cases import SF, documents, empty, given, rows_of

import corpus_pipeline
from postflow.llm import near_dedup as N


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_classes(rows):
    """doc_id to the smallest doc_id it reaches, over all pairs with a Jaccard similarity of 0.8 or more."""
    sets, label = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    return [min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(rows))]


def expected(rows):
    return sorted(((k, c) for (k, _), c in zip(rows, slow_classes(rows))), key=repr)


def edited(words, edits, rnd):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = f"new{rnd.randrange(10**9)}"
    return words


def test_stage_against_all_pairs(spark):
    """Pairs that differ in more than two bits of their fingerprints are found."""
    docs = given("documents")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    stay = sorted((k,) for k, c in expected(rows) if k == c)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    found = stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert sorted(rows_of(found, "doc_id")) == stay
    assert not {(145,), (177,)} & set(stay)


def test_edge_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(N.near_duplicates(docs), "doc_id", "component_id") == expected(rows)
    assert N.near_duplicates(empty(spark)).collect() == []
    kept = N.kept_documents(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(1,), (2,), (5,), (7,)] + [(None,), (None,)]


def test_groups_chains_and_common_passages(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage, texts = [word() for _ in range(40)], []
    for size in (30, 60, 300):
        base = [word() for _ in range(size)]
        texts += [edited(base, rnd.randrange(size // 20 + 1), rnd) for _ in range(12)]  # a group about one text
        for _ in range(6):  # a chain: each about one edit's reach from the last, far from the first
            base = edited(base, max(1, size // 60), rnd)
            texts.append(base)
    for size in (5, 9, 12, 40, 200):  # a common passage in texts of many lengths
        texts += [[word() for _ in range(size)] + passage for _ in range(15)]
    texts += [[word() for _ in range(n)] for n in range(8)] * 2
    rnd.shuffle(texts)
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for many in (1, N.MANY):
        assert rows_of(N.near_duplicates(docs, many), "doc_id", "component_id") == expected(rows)


def test_similarity_is_reckoned_exactly():
    a = np.arange(1, 10, dtype=np.uint64)
    assert N.similar(a[:8], a[:8]) and N.similar(a[:4], a[:5]) and not N.similar(a[:7], a[:9])
    assert N.similar(a[:0], a[:0]) and len(N.prefix(a[:5], a[:0], a[:0].astype(np.int64))) == 2


def test_parities_never_rule_out_similar_sets():
    rnd = np.random.RandomState(4)
    for size in (1, 2, 9, 90, 900, 9000):
        a = np.unique(rnd.randint(0, 1 << 62, size).astype(np.uint64))
        b = np.sort(np.concatenate([a[size // 10 :], np.arange(size // 10, dtype=np.uint64)]))
        differ = np.bitwise_count(np.frombuffer(N.parity(a), np.uint8) ^ np.frombuffer(N.parity(b), np.uint8)).sum()
        assert N.similar(a, b) and 9 * int(differ) <= len(a) + len(b)


def test_fine_parities_never_rule_out_similar_sets_and_rule_out_others():
    rnd = np.random.RandomState(5)
    for size in (1, 9, 90, 900, 9000):
        a = np.unique(rnd.randint(0, 1 << 62, size).astype(np.uint64))
        for kept, alike in ((1.0, True), (0.9, True), (0.7, False), (0.0, False)):
            b = np.sort(np.concatenate([a[: round(size * kept)], np.arange(size - round(size * kept), dtype=np.uint64)]))
            for c in (b, b[: len(b) - len(b) // 20]):  # of another width, perhaps
                near = N._near(N._differ(N.fine_parity(a), N.fine_parity(c)), len(a) + len(c))
                assert near or not N.similar(a, c)
                assert alike or size < 90 or not near


def test_texts_of_common_passages_make_no_pairs(spark):
    """Texts that share whole passages by chance meet, but are not written as pairs: twice the texts, no more than twice the pairs."""
    rnd = random.Random(6)
    passages = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(25)) for _ in range(30)]
    texts = [" ".join(rnd.sample(passages, 8)) for _ in range(600)]
    made = []
    for size in (300, 600):
        docs = spark.createDataFrame(list(enumerate(texts[:size])), "doc_id long, text string")
        none = spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))
        shared = N._shared(N.cut(N._prefixes(docs, none)))
        made.append(N._meetings(shared.withColumn("root", shared["node"]), 0, True).count())
    assert made[1] <= 2 * made[0] + 20


def test_marks_never_rule_out_similar_sets():
    rnd = np.random.RandomState(7)
    for size in (1, 9, 90, 900):
        a = np.unique(rnd.randint(0, 1 << 62, size).astype(np.uint64))
        b = np.sort(np.concatenate([a[size // 10 :], np.arange(size // 10, dtype=np.uint64)]))
        differ = int(np.bitwise_count(N.folded(N.parity(a)) ^ N.folded(N.parity(b))).sum())
        assert N.similar(a, b) and N._near(differ, len(a) + len(b))


def test_simhash_comes_first_and_its_pairs_are_checked(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = [base, base[1:], base + ["end"], [f"w{rnd.randrange(10**6)}" for _ in range(400)], ["a", "b"], ["b", "a"]]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    seen, real = [], N._verified

    def spy(docs, rows, pairs):
        seen.append({(r["a"], r["b"]) for r in pairs.collect()})
        return real(docs, rows, pairs)

    monkeypatch.setattr(N, "_verified", spy)
    found = rows_of(N.near_duplicates(docs), "doc_id", "component_id")
    assert found == expected(list(enumerate(" ".join(t) for t in texts)))
    marks = [N.fingerprint(" ".join(t), 5) for t in texts]
    near = [(i, j) for i in range(6) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= N.RADIUS]
    names = [np.int64(np.uint64(N.name_of(N.shingles(" ".join(t), N.WordHashes()))).view(np.int64)) for t in texts]
    close = {(min(names[i], names[j]), max(names[i], names[j])) for i, j in near}
    assert seen[0] and seen[0] <= close  # the tiles' stars, at first; later rounds meet at shingles


def no_list(spark):
    return spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64)))


def test_a_shared_passage_has_one_entry_per_text(spark):
    """Shingles that the same texts have bring them together once, at the one that comes first in the order."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for many in (2, 3, 7):  # groups of texts that share a passage and little else
        passage = [word() for _ in range(80)]
        texts += [passage + [word() for _ in range(20)] for _ in range(many)]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    rows = N.cut(N._prefixes(docs, no_list(spark)))
    prefixes = {r["node"]: r["prefix"] for r in rows.collect()}
    met = [(r["shingle"], r["node"], r["place"]) for r in N._shared(rows).collect()]
    assert all(prefixes[node][place] == shingle for shingle, node, place in met)
    held = {}
    for node, found in prefixes.items():
        for shingle in found:
            held.setdefault(shingle, set()).add(node)
    kept = {}
    for shingle, node, _ in met:
        kept.setdefault(shingle, set()).add(node)
    groups = {frozenset(nodes) for nodes in held.values() if len(nodes) > 1}
    assert all(kept[s] == held[s] for s in kept) and len(kept) == len(groups) and {frozenset(k) for k in kept.values()} == groups
    for shingle, nodes in kept.items():  # before all others that the same nodes have
        alike = {s for s, n in held.items() if n == nodes}
        assert all(next(s for s in prefixes[n] if s in alike) == shingle for n in nodes)


def test_a_larger_table_shows_rarer_shingles(spark, monkeypatch):
    """A passage in a twentieth of the texts is known as common even if a sample of the least size holds it too seldom."""
    monkeypatch.setattr(N, "SAMPLE", 20)
    rnd = random.Random(10)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(12)]
    texts = [[word() for _ in range(8)] + (passage if k % 20 == 0 else []) for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    keys, counts = N._common(N.narrow(docs))
    assert set(N.shingles(" ".join(passage), N.WordHashes()).tolist()) <= set(keys.tolist()) and counts.min() >= N.COMMON
