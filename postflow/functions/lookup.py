"""Look-ups in tables of a fixed size, as one folded literal."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F


def looked_up(entries: dict[str, str]) -> Callable[[Column], Column]:
    """The value of a key, null when the table has none.

    The literal is keyed by first letter and then by text, because a map literal is
    searched from its start.
    """
    by_letter: dict[str, dict[str, str]] = {}
    for key, value in entries.items():
        by_letter.setdefault(key[0], {})[key] = value
    spelled = json.dumps(by_letter)

    def value(key: Column) -> Column:
        table = F.from_json(F.lit(spelled), "MAP<STRING, MAP<STRING, STRING>>")
        return F.try_element_at(F.try_element_at(table, F.substring(key, 1, 1)), key)

    return value


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def collapsed(text: Column) -> Column:
    """Single spaces only. Most texts have no double space, so the pattern rarely runs."""
    return F.trim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text))


def place_key(text: Column) -> Column:
    """The form place names are looked up under."""
    return collapsed(F.translate(text, ".", " "))
