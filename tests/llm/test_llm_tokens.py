"""Token store, token counts and subwords."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import ROWS, SF, documents, empty, given, rows_of
from tokenizers import Tokenizer

from postflow.llm import subwords, token_counts as C, token_store as T
from postflow.llm.mph import PerfectHash
from postflow.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "B", "é", "e\u0301", "Σ", "ß", "漢", "🙂", ".", ",", "'s", "'LL", "1", "23", "<|endoftext|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "\x00", "▁", "$$$"]


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 12))) for _ in range(n)]


# --- store ---

@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash(n):
    keys = np.array([(k - n // 2) * 0x3C6EF372FE94F82 % (1 << 63) - (1 << 62) for k in range(n)], np.int64)
    numbers = PerfectHash.build(keys).numbers(keys)
    assert sorted(numbers.tolist()) == list(range(n))


def test_encoder_against_whole_texts():
    with open(WORDS, encoding="utf-8") as source:
        encoder = T.Encoder(source.read())
    whole = Tokenizer.from_file(WORDS)
    rnd = random.Random(6)
    latin = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]
    texts = odd_texts(3000, 1) + given("documents").text.tolist()
    texts += ["".join(rnd.choices(latin + [" "] * 40, k=30)) for _ in range(2000)] + latin
    assert encoder.splits
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def expected_store(rows):
    whole, out, start = Tokenizer.from_file(WORDS), [], 0
    coded = [(k, whole.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows]
    for key, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_of_edge_rows(spark):
    docs = documents(spark)
    store = T.write_store(docs, WORDS, shard_bytes=1 << 18)
    assert store.shards.count() > 1
    keys = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    found = T.read_documents(store, T.look_up(store, keys), with_ids=True)
    got = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in found.collect()), key=lambda r: r[1])
    # Rows without a doc_id are told apart by their packed ids alone.
    want = expected_store([r[:2] for r in ROWS])
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert sorted(r[2:] for r in got if r[0] is None) == sorted(r[2:] for r in want if r[0] is None)
    short = found.where("doc_id = 1").first()["ids"]
    assert short == Tokenizer.from_file(WORDS).encode(ROWS[0][1], add_special_tokens=False).ids + [2]


def test_absent_keys_and_empty_tables(spark):
    store = T.write_store(documents(spark), WORDS)
    absent = spark.createDataFrame([(k,) for k in range(1000, 3000)], "doc_id long")
    found = T.read_documents(store, T.look_up(store, absent))
    assert found.where("doc_id IS NOT NULL").count() == 0
    store = T.write_store(empty(spark), WORDS)
    assert T.read_documents(store, T.look_up(store, absent)).count() == 0


def test_store_query_against_whole_texts(spark):
    docs = given("documents")
    expected = expected_store(list(zip(docs.doc_id.tolist(), docs.text.tolist())))
    assert rows_of(QUERIES["op6_token_store"](spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


# --- counts ---

def greedy(word, begin, inside):
    count = at = 0
    while at < len(word):
        known = inside if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return C.UNKNOWN
        count, at = count + 1, end
    return count


def test_automaton_against_greedy_matching():
    rnd = random.Random(3)
    for _ in range(1500):
        begin, inside = ({"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(0, 9))} for _ in range(2))
        automaton = C.LongestMatch(begin, inside)
        for _ in range(30):
            word = "".join(rnd.choices("abcd" if rnd.random() < 0.05 else "abc", k=rnd.randint(1, 14)))
            assert automaton.length(word) == greedy(word, begin, inside), (begin, inside, word)


def counted(text, begin, inside):
    lengths = [greedy(w.decode(), begin, inside) for w in (text or "").encode().split()]
    return len(lengths), sum(1 if n == C.UNKNOWN else n for n in lengths), lengths.count(C.UNKNOWN)


def test_counts(spark):
    pieces = C.vocabulary(spark, PIECES)
    begin, inside = map(set, pieces.value)
    rows = [r for r in ROWS if len(r[1] or "") < 1000] + [(100 + k, t, "x") for k, t in enumerate(odd_texts(300, 2))]
    expected = sorted(((k, *counted(t, begin, inside)) for k, t, _ in rows), key=repr)
    names = ("doc_id", "n_words", "n_tokens", "n_unknown")
    assert rows_of(C.token_counts(documents(spark, rows), pieces), *names) == expected
    assert C.token_counts(empty(spark), pieces).collect() == []
    assert C.token_counts(documents(spark), pieces).where("doc_id = 5").first()["n_words"] == 240_000
    docs = given("documents")
    expected = sorted(((k, *counted(t, begin, inside)) for k, t in zip(docs.doc_id.tolist(), docs.text)), key=repr)
    assert rows_of(QUERIES["op9_token_counts"](spark, SF), *names) == expected


# --- subwords ---

def test_paths_against_the_library():
    with open(PIECES, "rb") as source:
        own = subwords.Transducer(source.read())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts(4000, 4) + ["▁" * n for n in range(40)] + [" " * n + "x" for n in range(40)] + given("documents").text.tolist()
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), text


def test_other_models_are_refused(monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with open(PIECES, "rb") as source, pytest.raises(ValueError):
        subwords.Transducer(source.read())


def test_subword_round_trip(spark):
    model = subwords.load_model(spark, PIECES)
    docs = documents(spark)
    encoded = subwords.encode_documents(docs, model)
    assert encoded.where("round_trip").count() == docs.count()
    back = subwords.decode_documents(encoded, model)
    assert rows_of(back, "doc_id", "text") == sorted(((k, t or "") for k, t, _ in ROWS), key=repr)
    assert subwords.encode_documents(empty(spark), model).collect() == []


def test_subword_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = given("documents")
    expected = sorted(((k, library.encode(t)) for k, t in zip(docs.doc_id.tolist(), docs.text)), key=repr)
    assert rows_of(QUERIES["op2_sentencepiece"](spark, SF), "doc_id", "ids") == expected
