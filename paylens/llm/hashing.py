"""Vectorised 64-bit hashing of words and word n-grams, used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LONG_WORD = 64   # bytes; longer words are hashed one by one
CHUNK = 1 << 18  # bytes hashed at once


class WordHash:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, a chunk of text at a time.

    A word's hash is a polynomial in pseudorandom values of its bytes, taken as a
    difference of prefix sums, multiplied back by the inverse power of its start
    and mixed with its length.
    """

    def __init__(self) -> None:
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * GOLD)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
        n = CHUNK + 1
        self.power = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)))

    def of(self, text: bytes) -> np.ndarray:
        if len(text) <= CHUNK:
            return self._chunk(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            if end < len(text):  # cut at a blank: the last in the chunk, or the first behind a huge word
                blanks = np.flatnonzero(self.blank[np.frombuffer(text, np.uint8, end - at, at)])
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                else:
                    while end < len(text) and not self.blank[text[end]]:
                        end += 1
            piece = text[at:end]
            out.append(self._chunk(piece) if len(piece) <= CHUNK else
                       np.array([self._long(w) for w in piece.split()], np.uint64))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _long(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def _chunk(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate([[True], self.blank[b], [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.power[:len(b)], out=sums[1:])
        size = (stop - start).astype(np.uint64)
        out = mixed((sums[stop] - sums[start]) * self.back[start] + size * GOLD)
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = self._long(text[start[i]:stop[i]])
        return out


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, given the words' hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = mixed(np.array([seed + n], np.uint64) * GOLD)[0] | np.uint64(1)
    out = np.full(m, seed + 1, np.uint64)
    for j in range(n):
        out *= base
        out += words[j:j + m]
    return mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    rest = width - k
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x
