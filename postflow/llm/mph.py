"""A minimal perfect hash over 64-bit keys, built and probed on whole numpy arrays."""

from __future__ import annotations

import io

import numpy as np

_GAMMA = 2  # bits per key and level
_FINGERPRINT_SEED = 0x5EED


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (the splitmix64 finisher)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, _FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct keys to 0..n-1. Each level is a bit array in which a key that met no other
    at its place owns it; the others go one level deeper. A key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for level in levels:
            ones = np.cumsum(np.bitwise_count(level), dtype=np.int64)
            self.ranks.append(np.concatenate([[0], ones]) + before)
            before += int(ones[-1]) if len(ones) else 0
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            words = max(1, -(-_GAMMA * len(left) // 64))
            places = (mix(left, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(places, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[places]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not built in gets any number or -1."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for depth, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            place = (mix(keys[open_], depth) % np.uint64(64 * len(level))).astype(np.int64)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            held = (level[word] >> bit) & np.uint64(1) == 1
            below = level[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[held]] = (rank[word] + np.bitwise_count(below))[held]
            open_ = open_[~held]
        return out

    def save(self, to: io.IOBase) -> None:
        np.save(to, np.array([len(x) for x in self.levels], np.int64))
        np.save(to, np.concatenate([np.empty(0, np.uint64), *self.levels]))

    @classmethod
    def load(cls, source: io.IOBase) -> PerfectHash:
        sizes, words = np.load(source), np.load(source)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else [])
