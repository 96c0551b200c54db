import hashlib
import random
import re

from llm_cases import SF, documents, empty, given

from postflow.llm import pii as P
from postflow.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fits(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(7)
    parts = ["a", "@", "b.", "c", "@x.y", "1.", "22.", "255.", "256.", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "4", "\n", "é", "١"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        found = P.find_spans(text)
        assert {k: found.get(k, []) for k in PATTERNS} == brute(text), text


def test_spans_of_the_method():
    text = "write mailto:joe@x.org or ssh://bob:pw@host.net/a; IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789, account 7"
    found = P.find_spans(text)
    assert [text[a:b] for a, b in found["address"]] == ["mailto:joe@x.org", "ssh://bob:pw@host.net/a;"]
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "123-45-6789"]
    assert P.find_spans("no iban DE88 3704 0044 0532 0130 00, http://host/path, miban: 12345678") == {}


def test_redaction():
    text = "a b@c.de 1.2.3.4 z"
    assert P.redact(text, P.find_spans(text)) == "a <email> <ip> z"


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 80_000, "a." * 100_000 + "@", "1 " * 100_000 + "x", "x://" * 50_000):
        P.find_spans(text)


def test_edge_rows(spark):
    docs = documents(spark)
    assert P.personal_data(docs).count() == docs.count()
    assert {r["spans"] for r in P.personal_data(docs).collect()} == {""}
    assert P.personal_data(empty(spark)).collect() == []


def test_query_against_brute_force(spark):
    docs = given("documents")
    expected = {}
    for key, text in zip(docs.doc_id, docs.text):
        spans = brute(text)
        line = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])
        expected[key] = (*(len(spans[k]) for k in PATTERNS), hashlib.sha256(line.encode()).hexdigest())
    found = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in QUERIES["op3_pii"](spark, SF).collect()}
    assert found == expected
