"""Words of whole texts as arrays of 64-bit hashes, for operators that work on word sequences."""
from __future__ import annotations

import numpy as np
import xxhash

_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) → its 64-bit hash; forgets everything when it holds too many words."""

    def __init__(self, entries: int = 250_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.entries:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: bytes | None, lower: bool = False) -> np.ndarray:
        """The hashes of the text's words, runs of bytes other than space and U+0009 to U+000D."""
        words = (text or b"").translate(_UPPER_TO_LOWER).split() if lower else (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; another one for each seed."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name for each ordered pair of names."""
    return mix(mix(left, 1) + right, 2)
