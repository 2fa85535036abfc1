"""Hashes of the words of a text and of its word n-grams, by NumPy alone.

A word is a maximal run of bytes that are neither ASCII punctuation nor ASCII space, of the lower-cased text. A word's
hash comes from prefix sums of a polynomial modulo 2^64, so all words of a text are hashed at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = bytes(c if not (c < 128 and not chr(c).isalnum()) else 32 for c in range(256))
#: Only ASCII spaces part words, and only A-Z are lower-cased.
_SPACED = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CODES = np.random.default_rng(1).integers(1, 1 << 62, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word, in order; a null text has none."""
    return _hashes((text or "").lower().encode("utf-8", "replace").translate(_LETTERS))


def spaced_word_hashes(text: str | None) -> np.ndarray:
    """The same for words that only ASCII spaces part, of the text with A-Z lower-cased."""
    return _hashes((text or "").encode("utf-8", "surrogatepass").translate(_SPACED))


def words_of_texts(texts: list[str | None], most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The words of many texts, some at once, of about ``most`` bytes: number of the first text, hashes, where a text's begin.

    After each text's words stands a zero. The last of the places is where the last text's words would go on.
    """
    raw: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw.append((text or "").lower().encode("utf-8", "replace").translate(_LETTERS))
        size += len(raw[-1]) + 1
        if size >= most or i + 1 == len(texts):
            hashes, at = _hashed(b" ".join(raw))
            ends = np.cumsum([len(r) + 1 for r in raw])
            counts = np.diff(np.searchsorted(at, ends), prepend=0)
            begin = np.concatenate([[0], np.cumsum(counts + 1)])
            words = np.zeros(begin[-1], np.uint64)
            words[np.arange(len(hashes)) + np.repeat(np.arange(len(raw)), counts)] = hashes
            yield first, words, begin
            raw, size, first = [], 0, i + 1


def _hashes(raw: bytes) -> np.ndarray:
    return _hashed(raw)[0]


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and the bytes that they begin at."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` words from each place on."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * np.uint64(pow(_INVERSE, j + 1, 1 << 64))
    return mixed(h)
