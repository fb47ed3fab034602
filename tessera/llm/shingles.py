"""Hashed word shingles of a text."""

from __future__ import annotations

import numpy as np
import xxhash

from tessera.llm.text import ascii_words

#: Words whose hash a worker remembers.
_KEPT = 1 << 16


class _WordHash(dict):
    """64-bit hashes of words, kept for those seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHash()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``size`` words.

    A text of fewer words, but not none, has one hash of all of them; one without words has none.
    """
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    count = len(w) - width + 1
    h = np.full(count, np.uint64(width))
    for k in range(width):
        h = mixed(h + w[k : k + count])
    return np.unique(h)
