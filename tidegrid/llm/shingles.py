"""Sets of word shingles as sorted 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Words whose hash is kept.
MEMO = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text: A-Z lower-cased, words between ASCII white space.

    Fewer words than a shingle: the whole sequence is one. No words, or null: empty.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    mixed = h[:n].copy()
    for k in range(1, words):
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : k + n]
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)
