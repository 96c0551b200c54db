import random

import numpy as np
import xxhash
from llm_cases import SF, documents, empty, given, rows_of

from postflow.llm import simhash as S
from postflow.llm.queries import QUERIES


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in lower).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(pairs, radius=2):
    """doc_id to the smallest doc_id it reaches, over all pairs."""
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                label[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(pairs):
        groups.setdefault(root(i), []).append(key)
    return [min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(pairs))]


def test_fingerprint():
    texts = ["", " \n", "a", "A b", "Ab bC ÀÉ", "x y z x y z x y z", "one two three four five\u00a0six\x85seven"]
    texts += [" ".join(random.Random(n).choices(["ab", "Cd", "é", "f1"], k=n)) for n in range(30)]
    for text in texts:
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_edge_rows(spark):
    docs = documents(spark)
    found = S.near_duplicates(docs).collect()
    texts = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    expected = sorted(((k, f, c) for (k, f), c in zip(texts, slow_classes(texts))), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found), key=repr) == expected
    assert S.near_duplicates(empty(spark)).collect() == []


def test_links_hold_together_what_all_pairs_would(spark):
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(150)]
    for _ in range(450):  # chains, stars and far neighbours
        values.append(rnd.choice(values) ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3]))))
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for block in (16, 2048):
        found = S.contract(S.links(nodes, 2, block)).collect()
        root = {r["node"]: r["root"] for r in found}
        groups, expected = {}, {}
        for v, name in zip(signed, slow_classes(list(zip(range(len(values)), values)))):
            groups.setdefault(root.get(v, v), set()).add(v)
            expected.setdefault(name, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_large_group_gives_as_many_links_as_members(spark):
    centre = 0x0F0F0F0F0F0F0F0F
    values = {centre} | {centre ^ (1 << a) for a in range(64)} | {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    links = S.links(nodes).count()
    assert links < 50 * len(values)
    assert S.contract(S.links(nodes)).select("root").distinct().count() == 1


def test_one_document_of_each_class_stays(spark):
    docs = documents(spark)
    kept = S.kept_documents(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(1,), (2,), (5,), (7,)] + [(None,), (None,)]


def test_query_against_all_pairs(spark):
    docs = given("documents")
    pairs = [(k, slow_fingerprint(t)) for k, t in zip(docs.doc_id.tolist(), docs.text.tolist())]
    expected = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(pairs, slow_classes(pairs))), key=repr)
    assert rows_of(QUERIES["op5_simhash"](spark, SF), "doc_id", "fingerprint", "component_id") == expected
