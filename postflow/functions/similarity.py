"""Title similarity: token-sorted normalised indel similarity on a 0 to 100 scale.

The longest common subsequence is read off bit by bit: each letter of one text is the mask
of its places in the other, and the masks are folded over the places not matched yet. Texts
longer than a word of the machine take a word at a time and hand the carries on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

THRESHOLD = 95
# Places per word: a sum of two such numbers and a carry is still a long.
WORD = 62


def sorted_tokens(normalized: Column) -> Column:
    """The words of a normalised title in alphabetical order."""
    return F.array_join(F.array_sort(F.split(normalized, " ")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row of the table."""
    places: dict[str, int] = {}
    for position, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << position)
    mask = (1 << len(a)) - 1
    unmatched = mask
    for letter in b:
        hits = unmatched & places.get(letter, 0)
        unmatched = ((unmatched + hits) | (unmatched - hits)) & mask
    return len(a) - unmatched.bit_count()


def indel_similarity(a: str, b: str) -> float:
    """100 for equal texts (two empty texts included), 0 for nothing in common."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_subsequence(a, b) / total


def _letters(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _masks(text: Column) -> Column:
    """The places of each letter of a text of up to `WORD` letters; the last letter is the lowest bit."""
    letters = F.array_distinct(_letters(text))
    zeros = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(text)))

    def places(letter: Column) -> Column:
        return F.conv(F.call_function("translate", text, F.concat(letter, text), zeros), 2, 10).cast("long")

    return F.map_from_arrays(letters, F.transform(letters, places))


def _full(length: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), length.cast("int")) - F.lit(1).cast("long")


def _step(unmatched: Column, mask: Column, full: Column) -> Column:
    hits = unmatched.bitwiseAND(mask)
    return (unmatched + hits).bitwiseOR(unmatched - hits).bitwiseAND(full)


def _in_one_word(a: Column, letters: Column) -> Column:
    """The common subsequence of a text of up to `WORD` letters and the letters of another, last one first."""
    none = F.lit(0).cast("long")
    bound = F.struct(_masks(a).alias("masks"), _full(F.length(a)).alias("full"))
    left = let(bound, lambda s: F.aggregate(
        letters, s["full"], lambda v, c: _step(v, F.coalesce(F.try_element_at(s["masks"], c), none), s["full"])))
    return F.length(a) - F.bit_count(left)


def _in_words(a: Column, letters: Column) -> Column:
    """The same for a text of any length, from its last word on, with the carries of every letter."""
    none, length = F.lit(0).cast("long"), F.length(a)

    def block(state: Column, number: Column) -> Column:
        end = length - number * WORD
        size = F.least(end, F.lit(WORD))
        part = F.substring(a, end - size + 1, size)
        bound = F.struct(
            _masks(part).alias("masks"), _full(size).alias("full"), size.alias("size"),
            F.arrays_zip(letters.alias("c"), state["carries"].alias("in")).alias("rows"),
        )

        def fold(s: Column) -> Column:
            def row(v: Column, r: Column) -> Column:
                mask = F.coalesce(F.try_element_at(s["masks"], r["c"]), none)
                hits = v["left"].bitwiseAND(mask)
                return let(v["left"] + hits + r["in"], lambda total: F.struct(
                    total.bitwiseAND(s["full"]).bitwiseOR(v["left"] - hits).alias("left"),
                    F.concat(v["out"], F.array(F.call_function("shiftright", total, F.lit(WORD)))).alias("out")))

            start = F.struct(s["full"].alias("left"), F.array().cast("array<bigint>").alias("out"))
            return let(F.aggregate(s["rows"], start, row), lambda end: F.struct(
                (state["matched"] + s["size"] - F.bit_count(end["left"])).alias("matched"), end["out"].alias("carries")))

        return let(bound, fold)

    start = F.struct(F.lit(0).alias("matched"), F.array_repeat(none, F.size(letters)).alias("carries"))
    words = F.sequence(F.lit(0), F.floor((length - 1) / WORD).cast("int"))
    return F.aggregate(words, start, block)["matched"]


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    bound = F.struct(shorter.alias("a"), F.reverse(_letters(longer)).alias("letters"))
    return let(bound, lambda s: F.when(F.length(s["a"]) == 0, F.lit(0))
                .when(F.length(s["a"]) <= WORD, _in_one_word(s["a"], s["letters"])).otherwise(_in_words(s["a"], s["letters"])))


def sorted_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts whose tokens are already sorted."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when(a == b, F.lit(100.0)).otherwise(F.lit(200.0) * common_subsequence(a, b) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of two normalised titles whatever the order of their words."""
    return sorted_ratio(sorted_tokens(a), sorted_tokens(b))


def may_match(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """A native necessary condition for `sorted_ratio(a, b) >= threshold`.

    An indel distance is never below the Levenshtein distance, so a pair beyond the
    threshold's budget of edits cannot reach it.
    """
    total = F.length(a) + F.length(b)
    budget = F.floor(total * F.lit(100 - threshold) / 100).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= budget) & (F.levenshtein(a, b) <= budget)
