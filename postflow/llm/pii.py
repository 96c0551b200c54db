"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, schemes and
identifier words. A parser for the anchor's kind then reads outwards from it, once, and
checks what it found. Four kinds have fixed forms (email, ip, card, phone): the leftmost,
non-overlapping matches of their pattern, of which failing ones are dropped without a
second try. Two more come from the method: `address`, a scheme that names a person, and
`account`, an identifier behind a word that announces it.

Defined results: a null or empty text has no spans, and a null doc_id or a repeated row
gets a row like any other. Positions are code points, the end exclusive. Texts of any
length are read whole; every parser moves forwards only. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import narrow, small, texts_of

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
Span = tuple[int, int]

# Words that announce an identifier, in the cases that texts use.
IDENTIFIER_WORDS = ("iban", "ssn", "account", "acct", "passport", "konto", "cuenta", "compte")
# Schemes that lead to a person without an authority part.
PERSON_SCHEMES = ("mailto:", "tel:", "sip:")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_PERSON = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)?")
_AUTHORITY = re.compile(r"[A-Za-z0-9._%+-]++(?::[^\s@/]*+)?@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]++)?(?:/[^\s\"'<>]*+)?")
_LEAD = re.compile(r"(?:[ ]?(?:no|nr|number|id|is)\b\.?)?[ ]?[:#=]?[ ]?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9])++(?![A-Za-z0-9])")


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _ip_fits(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card_fits(found: str) -> bool:
    digits = _only_digits(found)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _phone_fits(found: str) -> bool:
    return 9 <= len(_only_digits(found)) <= 15


def _iban_fits(found: str) -> bool:
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *PERSON_SCHEMES, *sorted(_DIGITS)):
        found.add_word(word, (word, len(word)))
    for word in IDENTIFIER_WORDS:
        for form in (word, word.capitalize(), word.upper()):
            found.add_word(form, ("word", len(form)))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> Span | None:
    domain = _DOMAIN.match(text, at + 1)
    if not domain:
        return None
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _account(text: str, at: int) -> Span | None:
    """An identifier behind the word that ends at `at`."""
    lead = _LEAD.match(text, at).end()
    if lead == at:
        return None
    if (found := _IBAN.match(text, lead)) and _iban_fits(found[0]):
        return found.span()
    if (found := _NUMBER.match(text, lead)) and 6 <= len(_only_digits(found[0])) <= 17:
        return found.span()
    return None


def find_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, in order of their start."""
    spans: dict[str, list[Span]] = defaultdict(list)
    done: dict[str, int] = defaultdict(int)  # where the search for a kind goes on

    def take(kind: str, found: Span | None, fits: bool = True) -> None:
        if found:
            done[kind] = found[1]
            if fits:
                spans[kind].append(found)

    for end, (anchor, length) in _anchors().iter(text):
        at = end + 1 - length
        if anchor in _DIGITS:
            if at >= done["card"]:
                found = _CARD.match(text, at)
                done["card"] = at + 1
                if found:
                    take("card", found.span(), _card_fits(found[0]))
            if at >= done["ip"] and (at == 0 or text[at - 1] not in _DIGITS):
                found = _IP.match(text, at)
                if found:
                    take("ip", found.span(), _ip_fits(found[0]))
        elif anchor == "@":
            take("email", _email(text, at, done["email"]))
        elif anchor == "+":
            found = _PHONE.match(text, at)
            if found:
                take("phone", found.span(), _phone_fits(found[0]))
        elif anchor == "word":
            if at >= done["account"] and (at == 0 or not text[at - 1].isalnum()):
                take("account", _account(text, end + 1))
        else:
            start = at
            if anchor == "://":
                while start > done["address"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
            found = (_AUTHORITY if anchor == "://" else _PERSON).match(text, end + 1)
            if found and at >= done["address"] and (anchor != "://" or start < at):
                take("address", (start, found.end()))
    return spans


def render(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans.get(kind, ()))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans per kind as kind:start:end, and counts; one row per document."""
    columns = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [find_spans(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([len(f.get(k, ())) for f in found], pa.int64()) for k in KINDS),
                    pa.array([render(f, BASE) for f in found], pa.string()),
                    pa.array([render(f, KINDS) for f in found], pa.string()),
                ],
                names=columns,
            )

    return narrow(docs).mapInArrow(work, schema)


def redact(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, found in spans.items() for s, e in found):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans",
        "n_address", "n_account",
    )
