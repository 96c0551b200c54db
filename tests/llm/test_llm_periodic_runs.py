import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from llm_cases import SF, documents, empty, given

from postflow.llm import periodic_runs as R
from postflow.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def slow_runs(words):
    """Every period over the whole text, shortest first; a stretch found before has a smaller period."""
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    found, extents, n = [], set(), len(w)
    for q in range(1, n // 4 + 1):
        same = np.append(w[:-q] == w[q:], False)
        breaks = np.flatnonzero(~same)
        starts = np.concatenate(([0], breaks[:-1] + 1))
        long = breaks + q - starts >= max(6, 4 * q)
        for start, end in zip(starts[long].tolist(), (breaks + q)[long].tolist()):
            if (start, end) not in extents:
                extents.add((start, end))
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slowest_runs(words):
    """The definition, word by word."""
    n, found = len(words), []

    def has(start, end, q):
        return all(words[i] == words[i + q] for i in range(start, end - q))

    for start in range(n):
        for end in range(start + 6, n + 1):
            q = next((q for q in range(1, end - start) if has(start, end, q)), None)
            if q is None or end - start < max(6, 4 * q):
                continue
            if (start == 0 or words[start - 1] != words[start - 1 + q]) and (end == n or words[end] != words[end - q]):
                found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(key, text, plant=True):
    words = [w for w in (text or "").encode().split()]
    mark = zlib.crc32(str(key).encode()) if key is not None else 1
    if plant and mark % 10 == 0 and words:
        g, n = mark // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(found), *four, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf_dir", [SF, SF.replace("0.001", "0.01")])
def test_query_against_all_lags(spark, sf_dir):
    table = given("documents", sf_dir)
    expected = sorted((slow_row(k, t) for k, t in zip(table.doc_id.tolist(), table.text.tolist())), key=repr)
    assert rows_of(QUERIES["op13_periodic_runs"](spark, sf_dir)) == expected
    assert sum(r[1] > 0 for r in expected) > len(expected) // 20


def test_edge_rows(spark):
    docs = documents(spark)
    few = docs.where("doc_id IS DISTINCT FROM 5")  # the long text is too long for the slow form
    rows = [(r["doc_id"], r["text"]) for r in few.select("doc_id", "text").collect()]
    assert rows_of(R.digests(R.collapse(few, R.planted))) == sorted((slow_row(k, t) for k, t in rows), key=repr)
    assert R.collapse(empty(spark)).collect() == []
    found = {r["doc_id"]: r for r in R.collapse(docs).where("doc_id = 5").collect()}[5]
    assert found["collapsed"] == "Word after word, on and on." and [r["period"] for r in found["runs"]] == [6]


@pytest.mark.parametrize("seed", range(12))
def test_definition(seed):
    rnd = random.Random(seed)
    words = [rnd.choice("ab" if seed % 2 else "abc") for _ in range(40)]
    at = rnd.randrange(20)
    words[at:at] = words[at : at + 1 + seed % 4] * 5
    assert slow_runs(words) == slowest_runs(words)


def made(rnd):
    """Words with runs of all sorts: nested, overlapping, side by side, at the ends, with a word changed."""
    words, names = [], [f"w{i}" for i in range(rnd.choice([2, 3, 20, 300]))]
    for _ in range(rnd.randrange(1, 12)):
        block = [rnd.choice(names) for _ in range(rnd.randrange(1, rnd.choice([3, 9, 40])))]
        if rnd.random() < 0.3:
            block = block[: 1 + len(block) // 4] * rnd.randrange(1, 6)
        block = block * rnd.randrange(1, 9)
        block = block[: len(block) - rnd.randrange(0, 1 + len(block) // 3)]
        if block and rnd.random() < 0.3:
            block[rnd.randrange(len(block))] = "odd"
        words += block
    return words


@pytest.mark.parametrize("seed", range(300))
def test_made_texts(seed):
    words = made(random.Random(seed))
    assert R.runs(words) == slow_runs(words)


def test_long_texts_stay_cheap():
    rnd = random.Random(8)
    texts = [
        ["w"] * 300_000, ["a", "b", "c", "a", "b", "d", "e"] * 40_000, [rnd.choice("ab") for _ in range(60_000)],
        [f"w{rnd.randrange(10_000)}" for _ in range(25_000)] * 8, [f"w{rnd.randrange(60)}" for _ in range(100_000)],
        ["a" if bin(i).count("1") % 2 else "b" for i in range(60_000)],
    ]
    for words in texts:
        started = time.perf_counter()
        found = R.runs(words)
        assert time.perf_counter() - started < 30
        if len(words) in (200_000, 300_000, 280_000):
            assert len(found) == 1 and found[0][:2] == (0, len(words))


def test_splitting_only_saves_work(monkeypatch):
    texts = [made(random.Random(k)) for k in range(40)]
    whole = [R.runs(t) for t in texts]
    monkeypatch.setattr(R, "DEPTH", 1)
    assert [R.runs(t) for t in texts] == whole
