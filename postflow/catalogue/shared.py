"""Table access and SQL fragments the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.places import LocationRule
from ..plans.profile import Band, RepeatRules, SearchProfile
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the workers where its few files would not be."""
    return spread(table(spark, sf_dir, name))


def moment(column: str) -> Column:
    """A zone-less timestamp of the given tables as a UTC moment."""
    return F.col(column).cast("timestamp")


def stamp(column: Column | str) -> Column:
    """A moment as text, so that both sides of a comparison read alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# What the queries over `documents` look for. The words are ones the texts contain.
PROFILE = SearchProfile(
    title_include=["the thing", "attion", "que la", "nicht"],
    title_exclude=["thble", "erhe", "son"],
    strong=["thor", "ontion", "elle", "keit"],
    supporting=["from", "sich", "pour", "tion", "thon the"],
    seniority_exclude=["thaned", "schlich"],
    priority=[LocationRule(("onsite", "hybrid"), ("portugal", "switzerland"))],
    acceptable=[LocationRule(("onsite", "hybrid"), ("canada",)), LocationRule(("remote",), ("eu", "uk", "us"))],
    bands=[Band("Core", 80, 100), Band("Near", 40, 79), Band("Far", 0, 39)],
    threshold=70,
    max_scores_per_run=None,
    prompt_version=1,
)
RULES = RepeatRules(demote_after=3, suppress_after=5, reset_on_score_delta=10)

# The whitespace class of the library, as the oracle's regex dialect writes it.
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_words(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


def sql_space(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def sql_first_term(words: str, terms: list[str], prefix: bool = False) -> str:
    tail = "" if prefix else " "
    hits = " ".join(f"WHEN contains(' ' || {words} || ' ', ' {t}{tail}') THEN '{t}'" for t in terms)
    return f"CASE {hits} END"


def sql_tidy(e: str) -> str:
    """The spacing rules of plain text made from HTML."""
    lines = rf"regexp_replace({e}, '\r\n|[\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    spaces = rf"regexp_replace({lines}, '[ \t\x{{A0}}]+', ' ', 'g')"
    trimmed = rf"regexp_replace({spaces}, '[ \t]*\n[ \t]*', chr(10), 'g')"
    return sql_strip(rf"regexp_replace({trimmed}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_content_hash(company: str, title: str, location: str, description: str) -> str:
    parts = [sql_words(company), *[f"lower({sql_space(f'coalesce({x}, {chr(39) * 2})')})" for x in (title, location, description)]]
    return "sha256(" + " || chr(31) || ".join(parts) + ")"


def sql_indel_similarity(a: str, b: str) -> str:
    """Indel similarity of two texts of up to 100 characters, 0 to 100.

    The longest common subsequence bit by bit: each letter of `b` is the mask of its places
    in `a`, and the masks are folded over the places not matched yet.
    """
    full = f"((1::HUGEINT << length({a})) - 1::HUGEINT)"
    masks = (
        f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), "
        f"lambda i: CASE WHEN substr({a}, i::INT, 1) = c THEN 1::HUGEINT << (i::INT - 1) ELSE 0::HUGEINT END))::HUGEINT)"
    )
    left = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"200.0 * (length({a}) - bit_count({left})) / (length({a}) + length({b}))"
