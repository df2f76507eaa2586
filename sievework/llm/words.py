"""Words of whole texts and their 64-bit hashes in numpy, a bounded slice of documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries in a worker's dictionary of word hashes.
MEMORY = 200_000


class Hashes(dict):
    """Word -> XXH64. It is emptied when full; the values never depend on that."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, so that every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The odd multiplier of the hashes of sequences.
STEP = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, places: list[int] | range) -> np.ndarray:
    """A hash for each start: of the words at start + p for p in places. As many as there are starts with room for the last place."""
    n = len(h) - max(places)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for p in places:
        out = out * STEP + h[p : p + n]
    return mixed(out)
