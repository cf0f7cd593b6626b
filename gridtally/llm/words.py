"""Words of texts as 64-bit hashes, windows over them, and blobs dealt by hash."""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_WORDS = 400_000
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """UTF-8 word to its hash; starts over beyond a number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None, *, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return), A-Z lowered on request.

    bytes.split and bytes.lower look at ASCII only, which is what is asked for.
    """
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out *= ODD
        out += h[i : i + n]
    return mixed(out + np.uint64(size))


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket, and each bucket's bounds in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))
