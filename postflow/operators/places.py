"""Locations: free text to regions and a work mode, and regions to a location fit.

All of it is row-local: a posting's places are an array column, the gazetteer and the
rules are literals of fixed size. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookup import looked_up, place_key, words
from ..functions.places_data import (
    DEFAULT_GAZETTEER,
    NOISE_WORDS,
    OTHER,
    REGION_GROUPS,
    REGION_TOKENS,
    SUPRANATIONAL,
    UNKNOWN,
    Gazetteer,
)
from ..functions.text import SPACE, let, strip
from ..schemas import WORK_MODES

# What separates places in one text, and how boards spell a work mode.
SEPARATORS = r"\||;|/|&|,|\bor\b|\band\b| - |–|—"
STATED_MODES = {
    "remote": "remote", "hybrid": "hybrid", "onsite": "onsite", "office": "onsite", "inoffice": "onsite",
}


def _pieces(texts: Column) -> Column:
    """Every separated, trimmed, non-empty piece of every text, in order.

    Whitespace of every kind becomes a space once per text, so pieces need no patterns.
    """
    def split(text: Column) -> Column:
        spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]", " ")
        return F.transform(
            F.split(F.translate(spaced, "()", ",,"), SEPARATORS),
            lambda piece: F.trim(F.btrim(F.trim(piece), F.lit("."))),
        )

    return F.filter(F.flatten(F.transform(texts, split)), lambda piece: piece != "")


def stated_work_mode(workplace_type: Column, is_remote: Column) -> Column:
    """The work mode a board states outright: its own field, else its remote flag."""
    field = F.translate(F.lower(strip(workplace_type)), "_-", "")
    return F.coalesce(
        looked_up(STATED_MODES)(field),
        F.when(is_remote, F.lit("remote")).when(~is_remote, F.lit("onsite")),
    )


def parse_location(
    raw: Column,
    country_code: Column | None = None,
    workplace_type: Column | None = None,
    is_remote: Column | None = None,
    hints: Column | None = None,
    gazetteer: Gazetteer = DEFAULT_GAZETTEER,
) -> Column:
    """STRUCT<regions, region, work_mode> of one posting's location fields.

    Trusted in order: the ISO code, then the text, then the hints. A place outside the
    vocabulary counts as `other` and never enters `regions`; text that names nothing
    known is `unknown`.
    """
    absent = F.lit(None).cast("string")
    place_of, country_of = looked_up(gazetteer.lookup()), looked_up(gazetteer.iso2)
    noise, unresolvable = words(NOISE_WORDS), words(NOISE_WORDS | SUPRANATIONAL)

    code = F.upper(strip(country_code)) if country_code is not None else absent
    by_code = F.coalesce(
        country_of(code), F.when(F.regexp_like(code, F.lit(r"^\p{L}{2}$")), F.lit(OTHER))
    )

    def resolve(piece: Column) -> Column:
        words = F.filter(
            F.split(F.translate(piece, "-", " "), " "),
            lambda word: (word != "") & ~F.array_contains(noise, word),
        )
        found = F.coalesce(
            place_of(place_key(piece)),
            place_of(place_key(F.array_join(words, " "))),
        )
        return F.when(~F.array_contains(unresolvable, piece), found)

    texts = F.array(raw)
    if hints is not None:
        texts = F.concat(texts, F.coalesce(hints, F.array().cast("array<string>")))
    mode_stated = stated_work_mode(
        workplace_type if workplace_type is not None else absent,
        is_remote if is_remote is not None else F.lit(None).cast("boolean"),
    )

    def answer(pieces: Column, resolved: Column) -> Column:
        regions = F.array_distinct(F.array_remove(resolved, OTHER))
        any_place = F.size(resolved) > 0
        mode = F.coalesce(
            mode_stated,
            F.when(F.exists(pieces, lambda p: F.contains(p, F.lit("remote"))), F.lit("remote")),
            F.when(F.exists(pieces, lambda p: F.contains(p, F.lit("hybrid"))), F.lit("hybrid")),
            F.when(any_place, F.lit("onsite")),
            F.lit("unknown"),
        )
        region = F.coalesce(
            F.try_element_at(regions, F.lit(1)), F.when(any_place, F.lit(OTHER)), F.lit(UNKNOWN)
        )
        return F.struct(regions.alias("regions"), region.alias("region"), mode.alias("work_mode"))

    def read(pieces: Column) -> Column:
        tokens = F.concat(F.array(by_code), F.transform(pieces, resolve))
        return let(F.filter(tokens, lambda t: t.isNotNull()), lambda resolved: answer(pieces, resolved))

    return let(_pieces(texts), read)


def parse_locations(postings: DataFrame, gazetteer: Gazetteer = DEFAULT_GAZETTEER) -> DataFrame:
    """Posting records with a `location` struct column added."""
    return postings.withColumn(
        "location",
        parse_location(
            F.col("location_raw"), F.col("country_code"), F.col("workplace_type"),
            F.col("is_remote"), F.col("location_hints"), gazetteer,
        ),
    )


# --- location rules ----------------------------------------------------------------------


@dataclass(frozen=True)
class LocationRule:
    """Work modes wanted in regions; a region may be a country or a group."""

    work_modes: tuple[str, ...]
    regions: tuple[str, ...]


def expand(tokens: Iterable[str], groups: dict[str, list[str]] = REGION_GROUPS) -> list[str]:
    """Groups replaced by their members, other tokens as they are, without repeats."""
    return list(dict.fromkeys(chain.from_iterable(groups.get(token, [token]) for token in tokens)))


def expand_regions(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """The frame form of `expand`: one row per country a token stands for.

    `groups` is (group, country). Tokens that are no group pass through.
    """
    members = groups.select(F.col("group").alias("_group"), "country")
    return (
        df.join(members, F.col(column) == F.col("_group"), "left")
        .withColumn(column, F.coalesce("country", column))
        .drop("_group", "country")
        .distinct()
    )


def unknown_tokens(tokens: Iterable[str]) -> list[str]:
    """Tokens that are no country and no group, sorted."""
    return sorted(set(tokens) - set(REGION_TOKENS))


def check_rules(rules: Iterable[LocationRule]) -> list[str]:
    """What is wrong with a rule list: unknown regions or work modes, empty rules."""
    problems = []
    for number, rule in enumerate(rules, start=1):
        if not rule.regions or not rule.work_modes:
            problems.append(f"rule {number} is empty")
        problems += [f"rule {number}: unknown region {t}" for t in unknown_tokens(rule.regions)]
        problems += [f"rule {number}: unknown work mode {m}" for m in rule.work_modes if m not in WORK_MODES]
    return problems


def location_match(
    region: Column,
    regions: Column,
    work_mode: Column,
    priority: Iterable[LocationRule],
    acceptable: Iterable[LocationRule],
) -> Column:
    """STRUCT<fit, place>: the best fit any of a job's places earns, and the first that does.

    `unknown` when the place or the work mode is not known, `excluded` when no rule wants
    any of the places.
    """
    def wanted(rules: Iterable[LocationRule]) -> Column:
        keys = {f"{place}|{mode}" for rule in rules for place in expand(rule.regions) for mode in rule.work_modes}
        return words(keys) if keys else F.array().cast("array<string>")

    places = F.when(F.size(F.coalesce(regions, F.array().cast("array<string>"))) > 0, regions).otherwise(F.array(region))

    def first_place(rules: Iterable[LocationRule]) -> Column:
        keys = wanted(rules)
        hits = F.filter(places, lambda p: F.array_contains(keys, F.concat(p, F.lit("|"), work_mode)))
        return F.try_element_at(hits, F.lit(1))

    def answer(fit: str, place: Column) -> Column:
        return F.struct(F.lit(fit).alias("fit"), place.cast("string").alias("place"))

    best, second = first_place(priority), first_place(acceptable)
    return (
        F.when((region == UNKNOWN) | (work_mode == "unknown"), answer("unknown", F.lit(None)))
        .when(best.isNotNull(), answer("priority", best))
        .when(second.isNotNull(), answer("acceptable", second))
        .otherwise(answer("excluded", F.lit(None)))
    )


def matched_elsewhere(place: Column, region: Column) -> Column:
    """The place that earned the fit, only when it is not the region on display."""
    return F.when(place != region, place)


def check_gazetteer(gazetteer: Gazetteer) -> list[str]:
    """Tokens a gazetteer can emit that no rule could ever name."""
    known = set(REGION_TOKENS) | {OTHER}
    return sorted({t for t in [*gazetteer.places.values(), *gazetteer.iso2.values()] if t not in known})

