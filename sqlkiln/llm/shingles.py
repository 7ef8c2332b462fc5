"""Word shingle sets as sorted 64-bit hashes (executor-side numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_WORDS = 100_000


class WordHashes(dict):
    """word bytes -> 64-bit hash, kept for the words met so far (bounded)."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = h
        return h


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits (wraps mod 2^64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of ``text``.

    A-Z is lower-cased, words are runs of anything but ASCII white space.
    Fewer words than ``width``: the whole sequence is the one shingle; no
    words or null: empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    # the word count goes in, so a short text never equals part of a long one
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - span + 1 + i])
    return np.unique(out)
