"""A segment index for texts within a share of edits of each other.

Two texts of lengths l and m are as alike as a threshold asks if at most floor((l + m) *
alike) letters are put in or taken out, `alike` being (100 - threshold) / 100. A text of
length l is cut into one segment more than the edits it can have to any text: whatever the
edits, some segment i is left whole, with at most i edits before it and no more behind it
than segments follow. The other text holds it at a place shifted by no more than that, so
texts meet at (length, segment, letters) and no like pair is missed. What a text is looked
up by depends on its own length, never on how many other texts there are.

The native form and the one for tasks use the same bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

from pyspark.sql import Column, functions as F

from .binding import let

_SLACK = 1e-9


def _share(threshold: int) -> float:
    return (100 - threshold) / 100


def lengths(length: int, threshold: int) -> range:
    """The lengths of texts that can be like one of `length`."""
    alike = _share(threshold)
    return range(-floor(-(length * (1 - alike) / (1 + alike) - _SLACK)), floor(length * (1 + alike) / (1 - alike) + _SLACK) + 1)


def edits(one: int, other: int, threshold: int) -> int:
    return floor((one + other) * _share(threshold) + _SLACK)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a text of `length`."""
    parts = edits(length, lengths(length, threshold)[-1], threshold) + 1
    places = [i * length // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(places, places[1:])]


def entries(text: str, threshold: int) -> Iterator[tuple[int, int, str]]:
    """What a text is held by."""
    for i, (start, size) in enumerate(segments(len(text), threshold)):
        yield len(text), i, text[start : start + size]


def shifts(length: int, segment: int, parts: int, asked: int, threshold: int) -> range:
    """Where a text of length `asked` can hold a segment of one of `length`, next to the segment's own place."""
    grown, most, behind = asked - length, edits(length, asked, threshold), parts - 1 - segment
    low = max(-segment, grown - behind, -((most - grown) // 2))
    return range(low, min(segment, grown + behind, (most + grown) // 2) + 1)


def probes(text: str, threshold: int) -> Iterator[tuple[int, int, str]]:
    """What a text is looked up by."""
    for length in lengths(len(text), threshold):
        cut = segments(length, threshold)
        for i, (start, size) in enumerate(cut):
            for shift in shifts(length, i, len(cut), len(text), threshold):
                if 0 <= start + shift <= len(text) - size:
                    yield length, i, text[start + shift : start + shift + size]


# --- the same as columns -----------------------------------------------------------------


def _bound(value: Column, down: bool = True) -> Column:
    return (F.floor(value + _SLACK) if down else F.ceil(value - _SLACK)).cast("int")


def _lengths(length: Column, threshold: int) -> Column:
    alike = _share(threshold)
    return F.sequence(
        _bound(length * ((1 - alike) / (1 + alike)), down=False), _bound(length * ((1 + alike) / (1 - alike))))


def _parts(length: Column, threshold: int) -> Column:
    alike = _share(threshold)
    return _bound((length + _bound(length * ((1 + alike) / (1 - alike)))) * alike) + 1


def _place(segment: Column, length: Column, parts: Column) -> Column:
    return F.floor(segment * length / parts).cast("int")


def _key(block: Column, length: Column, segment: Column, letters: Column) -> Column:
    return F.xxhash64(block, length, segment, letters)


def _cut(segment: Column, length: Column, parts: Column) -> Column:
    """(start, size) of a segment."""
    start, end = _place(segment, length, parts), _place(segment + 1, length, parts)
    return let(start, lambda at: F.struct(at.alias("start"), (end - at).alias("size")))


def entry_keys(block: Column, text: Column, threshold: int) -> Column:
    """An array of hashes: what a text of `block` is held by."""
    length = F.length(text)

    def of_parts(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: let(
            _cut(i, length, parts), lambda c: _key(block, length, i, F.substring(text, c["start"] + 1, c["size"]))))

    return let(_parts(length, threshold), of_parts)


def probe_keys(block: Column, text: Column, threshold: int) -> Column:
    """An array of hashes: what a text of `block` is looked up by."""
    asked, alike = F.length(text), _share(threshold)

    def of_length(length: Column) -> Column:
        bounds = F.struct(
            _parts(length, threshold).alias("parts"), (asked - length).alias("grown"),
            _bound((length + asked) * alike).alias("most"))

        def of_bounds(b: Column) -> Column:
            least, greatest = -F.floor((b["most"] - b["grown"]) / 2).cast("int"), F.floor((b["most"] + b["grown"]) / 2).cast("int")

            def of_segment(i: Column) -> Column:
                behind = b["parts"] - 1 - i

                def of_cut(c: Column) -> Column:
                    low = F.greatest(-i, b["grown"] - behind, least, -c["start"])
                    high = F.least(i, b["grown"] + behind, greatest, asked - c["size"] - c["start"])
                    places = F.when(low <= high, F.sequence(low + c["start"] + 1, high + c["start"] + 1))
                    return F.transform(
                        F.coalesce(places, F.array().cast("array<int>")),
                        lambda at: _key(block, length, i, F.substring(text, at, c["size"])))

                return let(_cut(i, length, b["parts"]), of_cut)

            return F.flatten(F.transform(F.sequence(F.lit(0), b["parts"] - 1), of_segment))

        return let(bounds, of_bounds)

    return F.flatten(F.transform(_lengths(asked, threshold), of_length))
