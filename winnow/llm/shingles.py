"""Words and 5-word shingles as 64-bit numbers, for the operators on whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_MAX_WORDS = 200_000
_U64 = np.uint64


class _Hashes(dict):
    """64-bit hash of a word, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Maximal runs of other bytes than space and 09-0D; A-Z lower-cased if asked."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """One number per run of ``width`` words, in order: a polynomial in scrambled words, by doubling."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    out, size, done, reach = None, 1, 0, mixed(words)
    count, power = len(words) - width + 1, 0x2545F4914F6CDD1D  # base ** size, modulo 2 ** 64
    while True:
        if width & size:
            part = reach[done:done + count]
            out = part.copy() if out is None else out * _U64(power) + part
            done += size
        if size * 2 > width:
            return mixed(out)
        reach = reach[:-size] * _U64(power) + reach[size:]
        power = power * power % (1 << 64)
        size *= 2


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``width`` are one shingle, no words none."""
    words = hashed(words_of(text, lower=True))
    if not len(words):
        return words
    return np.unique(runs(words, width) if len(words) >= width else runs(words, len(words)) + _U64(len(words)))
