"""Words of UTF-8 texts as 64-bit hashes, in numpy arrays over a batch of texts.

The helpers run inside Spark's Python tasks. A text is given as bytes, or None for a null
text, which has no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Code points that separate words in most operators: space and U+0009 to U+000D.
#: ``bytes.split()`` without an argument splits at exactly these.
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """Hash of a word on first sight, remembered while the memory is small."""

    def __init__(self, seed: int = 0, most: int = 50_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def combine(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of several aligned arrays, order included."""
    out = np.full(len(parts[0]), salt, U64)
    for p in parts:
        out = mix(out * _ODD + p)
    return out


def rolling(h: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, by doubling (wrapping arithmetic)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    m = multiplier | 1
    out, done = np.zeros(n, U64), 0
    run, width, power = h, 1, m  # run: hash of every run of `width`, power: m ** width
    rest = size
    while rest:
        if rest & 1:
            out = out * U64(power) + run[done : done + n]
            done += width
        rest >>= 1
        if rest:
            run = run[:-width] * U64(power) + run[width:]
            width, power = width * 2, power * power % 2**64
    return out


def sub_batches(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about ``most`` at most; a single
    larger row is a range of its own."""
    start, total, at = 0, 0, 0
    for at, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, at - 1
            start, total = at - 1, 0
        total += size
    if at > start:
        yield start, at
