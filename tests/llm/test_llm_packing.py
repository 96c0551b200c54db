import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import SF, documents, empty, given
from tokenizers import Tokenizer

from postflow.llm import packing as P
from postflow.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def slow_ids(texts):
    model = Tokenizer.from_file(PATH)
    return [model.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def slow_pieces(rows, size=P.SIZE):
    out = []
    for (key, _), ids in zip(rows, slow_ids([t for _, t in rows])):
        for number, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            out.append((key, number, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=repr)


def slow_packing(lengths, size):
    """How full the sequences are: one piece after the other, the tightest sequence by looking at all."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i in range(len(room)) if room[i] >= length]
        at = min(fits, key=lambda i: room[i]) if fits else len(room)
        if at == len(room):
            room.append(size)
        room[at] -= length
    return Counter(size - r for r in room)


def contents(rows, size):
    """How full the sequences are, after checking that their pieces lie side by side from 0 on."""
    by, full = {}, Counter()
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= size
        full[end] += 1
    return full


def test_query_against_one_by_one(spark):
    table = given("documents")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist()))
    df = QUERIES["op12_packing"](spark, SF)
    assert df.columns == COLUMNS
    found = df.collect()
    expected = slow_pieces(rows)
    assert sorted((tuple(r[c] for c in COLUMNS[:5]) for r in found), key=repr) == expected
    assert contents(found, P.SIZE) == slow_packing([e[3] for e in expected], P.SIZE)


def test_edge_rows_and_whole_sequences(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for size in (7, P.SIZE):
        packed = P.pack(docs, PATH, size=size, with_ids=True)
        found, expected = packed.collect(), slow_pieces(rows, size)
        assert sorted((tuple(r[c] for c in COLUMNS[:5]) for r in found), key=repr) == expected
        filled = contents(found, size)
        if size > 7:
            assert filled == slow_packing([e[3] for e in expected], size)
        whole = P.sequences(packed).collect()
        assert len(whole) == sum(filled.values())
        assert Counter(i for r in whole for i in r["ids"]) == Counter(i for ids in slow_ids([t for _, t in rows]) for i in ids)
    assert P.pack(empty(spark), PATH).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 2, 10, 64, 100])
    most = rnd.choice([1, size // 2 + 1, size])
    counts = Counter(rnd.randint(1, most) for _ in range(rnd.choice([0, 1, 30, 400])))
    runs = P.plan(counts, size)
    held = {}
    for length, number in counts.items():
        own = [r for r in runs.tolist() if r[0] == length]
        ends = [r[1] for r in own[1:]] + [number]
        assert not own or own[0][1] == 0
        for (_, first, sequence, each, offset), end in zip(own, ends):
            for rank in range(first, end):
                step = rank - first
                held.setdefault(sequence + step // each, []).append((offset + step % each * length, length))
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, pieces in held.items() for o, n in pieces]
    assert contents(rows, size) == slow_packing(list(counts.elements()), size)


def test_plan_does_not_grow_with_the_pieces():
    rnd = random.Random(1)
    counts = Counter(min(P.SIZE, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(100_000))
    few, many = P.plan(counts), P.plan({n: c * 10**6 for n, c in counts.items()})
    assert len(many) < 60_000 and len(few) < 60_000
    used = (many[:, 2].max() + 1) * P.SIZE
    assert sum(n * c for n, c in counts.items()) * 10**6 > 0.99 * used


def test_tightest_room():
    rooms = P.Rooms(9)
    assert rooms.tightest(0) is None
    for room in (3, 9, 5):
        rooms.add(room, room, 1)
    assert [rooms.tightest(k) for k in range(10)] == [3, 3, 3, 3, 5, 5, 9, 9, 9, 9]
    assert rooms.take(9) == (9, 1) and rooms.tightest(6) is None
