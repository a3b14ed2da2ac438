"""Words of whole texts as 64-bit hashes, shared by the operators that work on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Odd multipliers of the mixing functions.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, then the runs of bytes between ASCII white space (0x20 and 0x09 to 0x0D)."""
    return (text or "").encode().lower().split()


class WordHashes(dict):
    """Hash of each word, kept for the words seen so far; ``trim`` bounds how many."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self, limit: int = 400_000) -> None:
        if len(self) > limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring words; run ``i`` starts at word ``i``."""
    n = len(hashes) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * M1 + hashes[j:j + n]
    return mix(out)
