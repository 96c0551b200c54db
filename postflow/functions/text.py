"""Text expressions: whitespace, names, hashes, HTML, term search, slugs.

Everything is a native column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from .lookup import looked_up

# Fixed value: the characters Python counts as whitespace, as a regex class body.
# Spark's own \s is ASCII only.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# The same without the plain space, without the line feed, and spelled out for trimming.
_UNUSUAL = SPACE.replace(r"\x1C-\x20", r"\x1C-\x1F")
_IN_LINE = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
_ALL_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(r"\s", c))

UNIT_SEPARATOR = "\x1f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(col, F.lit(_ALL_SPACES))


def normalize_whitespace(col: Column) -> Column:
    """Runs of whitespace become one space; null becomes empty.

    A single plain space is left alone, so the pattern rarely has anything to replace.
    """
    runs = f"[{_UNUSUAL}][{SPACE}]*| [{SPACE}]+"
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), runs, " "))


def words_only(col: Column) -> Column:
    """Lower-case ASCII letters and digits, every other run a single space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_company(col: Column) -> Column:
    """The comparable form of a company name. Legal suffixes are kept."""
    return words_only(col)


def slug_for(col: Column) -> Column:
    """A slug from a company name: lower case, hyphens; null when nothing is left."""
    hyphenated = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(hyphenated, "^-+|-+$", ""), F.lit(""))


# --- hashes ------------------------------------------------------------------------------


def sha256(*parts: Column) -> Column:
    """SHA-256 over the parts joined by the unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def content_hash(company: Column, title: Column, location: Column, description: Column) -> Column:
    """Hash of everything a scorer reads, insensitive to case and spacing."""
    return sha256(
        normalize_company(company),
        F.lower(normalize_whitespace(title)),
        F.lower(normalize_whitespace(location)),
        F.lower(normalize_whitespace(description)),
    )


def canonical_key(company: Column, normalized_title: Column, region: Column) -> Column:
    """The deterministic identity of an opening."""
    return sha256(normalize_company(company), normalized_title, region)


def raw_hash(raw: Column) -> Column:
    """Hash of a JSON payload that ignores the order of object keys but not of arrays.

    A VARIANT stores object fields sorted by name, so writing it back gives a canonical
    form. Text that is not JSON is hashed as it stands.
    """
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(raw)), raw, F.lit("")), 256)


# --- HTML --------------------------------------------------------------------------------

# Fixed value: the tags that break a line.
BLOCK_TAGS = (
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table thead tbody section article "
    "header footer blockquote pre hr dd dt"
).split()

_ATTRIBUTES = r"""(?:[^"'>]|"[^"]*+"|'[^']*+')*+"""
_HIDDEN = rf"(?is)<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\z)"
_COMMENT = r"(?s)<!--.*?(?:--!?>|\z)"
_DECLARATION = r"<[!?][^>]*+>|</(?![a-zA-Z])[^>]++>"
_ITEM = rf"(?i)<li(?=[\s/>]){_ATTRIBUTES}>"
_BLOCK = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>]){_ATTRIBUTES}>"
_TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}>"


# Named references by the standard library's table. Those without a semicolon also count in
# front of other letters.
_NAMED = looked_up(html5)
_OPEN_NAMES = {name: value for name, value in html5.items() if not name.endswith(";")}
_OPEN_NAMED = looked_up(_OPEN_NAMES)
_OPEN_SIZES = sorted({len(name) for name in _OPEN_NAMES}, reverse=True)
# HTML reads the codes from 128 to 159 as the bytes of Windows-1252.
_CONTROL_CODES = {str(c): bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
_CONTROL_CODE = looked_up(_CONTROL_CODES)


def _character(code: Column) -> Column:
    """The text of a numeric reference: U+FFFD for codes that are none, nothing for non-characters."""
    spelled = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    silent = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
        | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\uFFFD"))
        .when(code.between(0x80, 0x9F), _CONTROL_CODE(code.cast("string")))
        .when(silent, F.lit("")).otherwise(spelled)
    )


def _numeric(piece: Column) -> Column:
    """What stands behind an ampersand, if it is a numeric reference, decoded; else null."""
    form = r"^#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?"
    decimal, hexadecimal = (F.regexp_extract(piece, form, k) for k in (1, 2))
    # Eight digits are beyond every code either way.
    code = F.when(
        decimal != "", F.when(F.length(decimal) < 8, decimal).otherwise(F.lit("9999999")).cast("bigint")
    ).otherwise(F.conv(F.when(F.length(hexadecimal) < 8, hexadecimal).otherwise(F.lit("FFFFFFF")), 16, 10).cast("bigint"))
    return F.when(F.regexp_like(piece, F.lit(form)), F.concat(let(code, _character), F.regexp_replace(piece, form, "")))


def _named(piece: Column) -> Column:
    """What stands behind an ampersand with a named reference at its start decoded."""
    def decoded(name: Column) -> Column:
        rest = F.substring(piece, F.length(name) + 1, F.length(piece))
        shorter = [
            F.when(F.length(name) > size, F.concat(
                _OPEN_NAMED(F.substring(name, 1, size)), F.substring(name, F.lit(size + 1), F.length(name))))
            for size in _OPEN_SIZES
        ]
        return F.concat(F.coalesce(_NAMED(name), *shorter, F.concat(F.lit("&"), name)), rest)

    return let(F.regexp_extract(piece, r"^([^\t\n\f <&#;]{1,32};?)", 1), decoded)


def decode_entities(text: Column) -> Column:
    """One layer of HTML character references decoded. Texts without an ampersand are left alone."""
    pieces = F.transform(
        F.split(text, "&", -1), lambda piece, i: F.when(i == 0, piece).otherwise(F.coalesce(_numeric(piece), _named(piece))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def without_markup(markup: Column) -> Column:
    """HTML with its tags, scripts and comments gone; entities are still encoded."""
    text = F.coalesce(markup, F.lit(""))
    for pattern, replacement in (
        (_COMMENT, ""),
        (_HIDDEN, ""),
        (_DECLARATION, ""),
        (_ITEM, "\n- "),
        (_BLOCK, "\n"),
        (_TAG, ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def tidy_lines(text: Column) -> Column:
    """Single spaces, trimmed lines, at most one blank line in a row."""
    for pattern, replacement in (
        (r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n"),
        (r"[\t\xA0][ \t\xA0]*| [ \t\xA0]+", " "),
        (f"[{_IN_LINE}]+\n", "\n"),
        (f"\n[{_IN_LINE}]+", "\n"),
        ("\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def html_to_text(markup: Column, escaped: bool = False) -> Column:
    """The readable text of an HTML fragment, blocks as lines and list items as bullets.

    `escaped` is for sources that send HTML escaped once more.
    """
    source = decode_entities(F.coalesce(markup, F.lit(""))) if escaped else markup
    return tidy_lines(decode_entities(without_markup(source)))


def html_array_to_text(fragments: Column) -> Column:
    """`html_to_text` for every element of an array."""
    return F.transform(fragments, lambda fragment: html_to_text(fragment))


# --- term search -------------------------------------------------------------------------


def _phrase(term: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", term.lower()).strip()


def first_term(normalized: Column, terms: Sequence[str], prefix: bool = False) -> Column:
    """The first of `terms`, in list order, that occurs as whole words; null when none does.

    `normalized` must already be `words_only` text. With `prefix` a term also matches a
    longer word it starts. For some hundred terms or more use `first_terms`.
    """
    tail = "" if prefix else " "
    phrases = [(term, f" {_phrase(term)}{tail}") for term in terms if _phrase(term)]
    if not phrases:
        return F.lit(None).cast("string")

    def first(padded: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(padded, F.lit(phrase)), F.lit(term)) for term, phrase in phrases])

    return let(F.concat(F.lit(" "), normalized, F.lit(" ")), first)


def first_terms(df, key: str, normalized: str, terms):
    """`first_term` for a large term frame (ordinal INT, term STRING).

    Word n-grams up to the longest term are matched by an equi-join, so the work does not
    grow with rows times terms. The vocabulary is broadcast while it is small, which drops
    nearly all n-grams before anything is shuffled. Returns (key, term).
    """
    vocabulary = (
        terms.select("ordinal", "term", words_only(F.col("term")).alias("phrase"))
        .where("phrase <> ''")
        .groupBy("phrase")
        .agg(F.min(F.struct("ordinal", "term")).alias("hit"))
    )
    longest = vocabulary.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = F.split(F.col(normalized), " ")
    grams = [words]
    for n in range(2, longest + 1):
        # Each longer run is the run before it with the word that follows. Runs past the
        # end of the text have no such word and are null.
        following = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
        grams.append(F.zip_with(grams[-1], following, lambda run, word: F.concat(run, F.lit(" "), word)))
    exploded = df.select(key, F.explode(F.flatten(F.array(*grams))).alias("phrase"))
    return (
        exploded.join(vocabulary, "phrase")
        .groupBy(key)
        .agg(F.min("hit").alias("hit"))
        .select(key, F.col("hit.term").alias("term"))
    )


# --- board tokens ------------------------------------------------------------------------

# Suffixes companies add to a board slug, and the board link patterns.
SLUG_SUFFIXES = ["-ai", "ai", "-labs", "labs", "-inc", "inc"]
BOARD_LINKS = {
    "greenhouse": r"(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([A-Za-z0-9-]+)",
    "lever": r"jobs\.lever\.co/([A-Za-z0-9-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9-]+)",
}
BOARD_PAGES = {
    "greenhouse": "https://job-boards.greenhouse.io/{token}",
    "lever": "https://jobs.lever.co/{token}",
    "ashby": "https://jobs.ashbyhq.com/{token}",
}
BOARD_APIS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{token}/jobs",
    "lever": "https://api.lever.co/v0/postings/{token}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{token}",
}


def slug_variants(name: Column) -> Column:
    """Plausible board slugs of a company, most likely first, as an array.

    The letters and digits of the name run together or hyphenated; then those without one
    of the usual endings; each as it is, and with the two forms of an "ai" behind it.
    """
    def spellings(parts: Column) -> Column:
        whole = [F.array_join(parts, ""), F.array_join(parts, "-")]
        stems = [F.rtrim(F.regexp_extract(w, f"^(..+){ending}$", 1), F.lit("-")) for w in whole for ending in SLUG_SUFFIXES]
        return F.array(*whole, *stems)

    parts = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1)
    known = F.filter(let(parts, spellings), lambda s: s != "")
    return F.array_distinct(F.flatten(F.transform(
        known, lambda s: F.transform(F.array(F.lit(""), F.lit("ai"), F.lit("-ai")), lambda tail: F.concat(s, tail)))))


def token_from_url(url: Column) -> Column:
    """STRUCT<ats, token> a careers link names, null when it points at no board."""
    return F.coalesce(
        *[
            F.when(
                F.regexp_extract(url, pattern, 1) != "",
                F.struct(F.lit(ats).alias("ats"), F.lower(F.regexp_extract(url, pattern, 1)).alias("token")),
            )
            for ats, pattern in BOARD_LINKS.items()
        ]
    )


def _from_template(templates: dict[str, str], ats: Column, token: Column) -> Column:
    filled = [
        F.when(
            (ats == name) & (token != ""),
            F.concat(*[token if part == "{token}" else F.lit(part)
                       for part in re.split(r"(\{token\})", template) if part]),
        )
        for name, template in templates.items()
    ]
    return F.coalesce(*filled)


def board_page(ats: Column, token: Column) -> Column:
    """The public page of a board, null when nothing is known to point at."""
    return _from_template(BOARD_PAGES, ats, token)


def board_api(ats: Column, token: Column) -> Column:
    """The address a board's postings are served from."""
    return _from_template(BOARD_APIS, ats, token)


# --- rendering for a model ---------------------------------------------------------------

def cut_text(text: Column, limit: int, mark: str) -> Column:
    """Text no longer than `limit`, with a mark on a line of its own when it was cut.

    For callers whose model bounds its input; nothing here cuts by itself.
    """
    def shortened(body: Column) -> Column:
        head = F.rtrim(F.substring(body, 1, limit), F.lit(_ALL_SPACES))
        return F.when(F.length(body) > limit, F.concat(head, F.lit("\n" + mark))).otherwise(body)

    return let(strip(F.coalesce(text, F.lit(""))), shortened)


def _or_empty(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(empty)"))


def render_posting(company, title, location_raw, region, work_mode, description) -> Column:
    """What a scorer reads about one posting: the whole of it."""
    body = _or_empty(strip(F.coalesce(description, F.lit(""))))
    place = F.coalesce(F.nullif(location_raw, F.lit("")), F.lit("not stated"))
    pieces = ["Company: ", company, "\nTitle: ", title, "\nLocation: ", place,
              " (parsed as region ", region, ", ", work_mode, ")\n\nDescription:\n", body]
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in pieces])


def render_prose(text: Column) -> Column:
    """What an extractor reads about one prose posting: the whole of it."""
    return F.concat(F.lit("Posting:\n"), _or_empty(strip(F.coalesce(text, F.lit("")))))
