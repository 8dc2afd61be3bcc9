"""Periodic runs of words by block convolution (operator 12).

A *run* is a stretch of consecutive words with smallest period q and length at
least ``max(MIN_RUN, 2 q)`` that neither neighbouring word extends.

*Dyadic scales.*  At scale L the periods L <= d < 2 L are searched.  A run of
period d has ``length - d >= max(MIN_RUN - d, d)`` starts i with
``word[i] = word[i + d]``, so for a block size B of half of that the stretch holds
a block ``[b, b + B)``, b a multiple of B, that occurs again at ``b + d``.

*Convolution.*  For each block the squared differences to every place of the window
``[b + L, b + 2 L + B)`` are summed at once: ``sum x^2 + sum y^2 - 2 sum x y``, the
last term by number-theoretic transforms.  Words are small integers numbered within
their document; the transform is repeated for as many primes as make their product
exceed the largest possible sum, so a sum is zero modulo all of them exactly if no
word differs.  Blocks whose first ``SIEVE`` words do not start again in the window
have no occurrence and are left out before.

*Extension.*  Occurrences of neighbouring blocks at the same distance join; the ends
are then moved by direct comparison as far as words at that distance agree.  Of equal
stretches the smallest distance is the period (longer ones are its multiples).
Occurrences inside a run already known whose period fits a block say nothing new
and are dropped, which keeps texts of one repeated word from quadratic time.

Documents are worked off in lots of about ``LOT`` words, so that short texts share
transforms; a longer document is a lot of its own.  Memory is in proportion to a lot,
transforms are done ``CELLS`` numbers at a time.

Results.  NULL, empty and blank texts have no words, no runs, NULL ``start``,
``length``, ``period`` and ``exponent_milli``, and digests of the empty string.  Rows
are independent: repeated rows give repeated results, a row without ``doc_id`` has no
planted repetition and is searched as it is.  An empty table gives no rows; extra
columns are not read.  Ties for the longest run go to the smallest start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.llm.hashing import GOLD, mixed

MIN_RUN = 12
SIEVE = 3
LOT = 1 << 17
CELLS = 1 << 18
BLOCK_MAX = 1 << 20  # a block is no longer, whatever the scale; its window is then cut into pieces
# Primes k 2^25 + 1 or with a higher power of two, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))


class Transform:
    """Number-theoretic transform of rows of length ``n`` (a power of two) modulo ``p``."""

    def __init__(self, n: int, p: int, g: int) -> None:
        self.n, self.p = n, np.uint64(p)
        self.inverse_n = np.uint64(pow(n, -1, p))
        root = pow(g, (p - 1) // n, p)
        self.steps = [self._powers(pow(root, n >> k, p), 1 << (k - 1)) for k in range(n.bit_length() - 1, 0, -1)]
        back = pow(root, -1, p)
        self.back = [self._powers(pow(back, n >> k, p), 1 << (k - 1)) for k in range(1, n.bit_length())]

    def _powers(self, r: int, count: int) -> np.ndarray:
        out, p = np.ones(1, np.uint64), int(self.p)
        while len(out) < count:
            out = np.concatenate([out, self.mod(out * np.uint64(pow(r, len(out), p)))])
        return out[:count]

    def mod(self, x: np.ndarray) -> np.ndarray:
        return x - x // self.p * self.p  # division by a scalar is vectorised, the remainder is not

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Transform in bit-reversed order."""
        for w in self.steps:
            h = len(w)
            x = x.reshape(len(x), -1, 2, h) if x.ndim == 2 else x
            a, b = x[:, :, 0], x[:, :, 1]
            y = np.empty_like(x)
            y[:, :, 0] = self.mod(a + b)
            y[:, :, 1] = self.mod((a + self.p - b) * w)
            x = y.reshape(len(x), -1)
        return x

    def reverse(self, x: np.ndarray) -> np.ndarray:
        """Inverse of :meth:`forward`."""
        for w in self.back:
            h = len(w)
            x = x.reshape(len(x), -1, 2, h)
            a, b = x[:, :, 0], self.mod(x[:, :, 1] * w)
            y = np.empty_like(x)
            y[:, :, 0] = self.mod(a + b)
            y[:, :, 1] = self.mod(a + self.p - b)
            x = y.reshape(len(x), -1)
        return self.mod(x * self.inverse_n)


_transforms: dict[tuple[int, int], Transform] = {}


def transform(n: int, p: int, g: int) -> Transform:
    """The transform of this size, kept by the worker (its tables hold ``4 n`` numbers)."""
    if (n, p) not in _transforms:
        _transforms[n, p] = Transform(n, p, g)
    return _transforms[n, p]


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether row r of ``blocks`` equals ``windows[r, j:j + B]``, for every r and j.

    By squared differences, exact in integers.
    """
    rows, size = blocks.shape
    places = windows.shape[1] - size + 1
    n = 1 << max(1, (windows.shape[1] - 1).bit_length())
    most = int(max(blocks.max(initial=0), windows.max(initial=0))) ** 2 * size + 1
    squares = np.zeros((rows, windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    of_windows = squares[:, size:size + places] - squares[:, :places]
    of_blocks = (blocks * blocks).sum(axis=1, dtype=np.uint64)[:, None]
    out, product = np.ones((rows, places), bool), 1
    for p, g in PRIMES:
        t = transform(n, p, g)
        x, y = np.zeros((rows, n), np.uint64), np.zeros((rows, n), np.uint64)
        x[:, :size] = blocks[:, ::-1]
        y[:, :windows.shape[1]] = windows
        both = t.reverse(t.mod(t.forward(x) * t.forward(y)))[:, size - 1:size - 1 + places]
        out &= t.mod(of_windows + of_blocks) == t.mod(both + both)
        product *= p
        if product > most:
            return out
    raise OverflowError("more words than the transforms can tell apart")


@dataclass
class Lot:
    """Documents laid end to end: word numbers, and for each place the end of its document."""

    words: np.ndarray
    ends: np.ndarray
    longest: int


def lot_of(texts: list[list[bytes]]) -> Lot:
    numbers, sizes = [], []
    for words in texts:
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__  # a new word gets the next number
        numbers.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
        sizes.append(len(words))
    sizes = np.array(sizes, np.int64)
    return Lot(np.concatenate(numbers) if numbers else np.empty(0, np.uint64),
               np.repeat(np.cumsum(sizes), sizes), int(sizes.max(initial=0)))


def block_size(scale: int) -> int:
    """Blocks of this size stand in every run with a period from ``scale`` to ``2 scale - 1``."""
    shortest = min(max(MIN_RUN - d, d) for d in range(scale, min(2 * scale, scale + MIN_RUN)))
    return min((shortest + 1) // 2, BLOCK_MAX)


class Sieve:
    """Where the first ``SIEVE`` words of a place start again in the same document."""

    def __init__(self, lot: Lot) -> None:
        n = max(0, len(lot.words) - SIEVE + 1)
        h = mixed(lot.ends[:n].astype(np.uint64))
        for j in range(SIEVE):
            h = h * GOLD + mixed(lot.words[j:j + n] + np.uint64(1))
        order = np.argsort(h, kind="stable")
        group = np.cumsum(np.concatenate([[0], h[order][1:] != h[order][:-1]])) if n else np.empty(0, np.int64)
        self.width = np.int64(len(lot.words) + 1)
        self.keys = group * self.width + order  # sorted by group, then place
        self.group = np.empty(n, np.int64)
        self.group[order] = group
        later = np.zeros(n, bool)
        later[order[:-1]] = group[1:] == group[:-1]
        self.again = np.flatnonzero(later)

    def occurring(self, places: np.ndarray, least: int, most: int) -> np.ndarray:
        """Those places that start again ``least`` to ``most`` words later."""
        if not len(places):
            return places
        of = self.group[places] * self.width + places
        at = np.searchsorted(self.keys, of + least)
        return places[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= of + most)]


def occurrences(lot: Lot, starts: np.ndarray, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``(b, d)``, ``scale <= d < 2 scale``, at which the block at b occurs again at b + d."""
    padded = np.concatenate([lot.words, np.zeros(3 * scale + size, np.uint64)])
    wide = min(scale, BLOCK_MAX)  # distances tried at once
    found_b, found_d = [], []
    per = max(1, CELLS // (wide + size))
    for lo in range(0, len(starts), per):
        b = starts[lo:lo + per]
        blocks = padded[b[:, None] + np.arange(size)]
        for first in range(scale, 2 * scale, wide):
            windows = padded[b[:, None] + np.arange(first, first + min(wide, 2 * scale - first) + size - 1)]
            row, j = np.nonzero(zero_mismatches(blocks, windows))
            d = first + j
            inside = b[row] + d + size <= lot.ends[b[row]]
            found_b.append(b[row][inside])
            found_d.append(d[inside])
    empty = np.empty(0, np.int64)
    return np.concatenate(found_b or [empty]), np.concatenate(found_d or [empty])


def extended(lot: Lot, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [lo, hi) of places that equal those d further, widened as far as they go."""
    n = len(lot.words)
    heads = np.flatnonzero(np.concatenate([[True], lot.ends[1:] != lot.ends[:-1]]))  # where documents start
    first = heads[np.searchsorted(heads, lo, "right") - 1]
    end = lot.ends[lo]
    lo, hi = lo.copy(), hi.copy()
    for step, edge in ((1, hi), (-1, lo)):
        live, width = np.arange(len(lo)), 4
        while len(live):
            at = (edge[live] if step > 0 else edge[live] - 1)[:, None] + step * np.arange(width)
            other = at + d[live][:, None]
            ok = (at >= first[live][:, None]) & (other < end[live][:, None])
            same = ok & (lot.words[np.clip(at, 0, n - 1)] == lot.words[np.clip(other, 0, n - 1)])
            far = np.where(same.all(axis=1), width, same.argmin(axis=1))
            edge[live] += step * far
            live = live[far == width]
            width = min(2 * width, max(4, CELLS // max(1, len(live))))
    return lo, hi


def runs_of_lot(lot: Lot) -> pd.DataFrame:
    """All runs ``(start, length, period)`` of a lot, places counted over the whole lot."""
    n = len(lot.words)
    known = pd.DataFrame({"start": np.empty(0, np.int64), "length": np.empty(0, np.int64), "period": np.empty(0, np.int64)})
    if n < MIN_RUN:
        return known
    sieve, scale = Sieve(lot), 1
    while 2 * scale <= lot.longest:
        size = block_size(scale)
        starts = sieve.again[sieve.again % size == 0]
        starts = starts[starts + scale + size <= lot.ends[starts]]
        starts = sieve.occurring(starts, scale, 2 * scale - 1)
        b, d = occurrences(lot, starts, size, scale)
        if len(b) and len(known):  # inside a known run whose period fits the block
            fits = known[known["period"] <= size]
            reach = np.zeros(n + 1, np.int64)
            np.maximum.at(reach, fits["start"].to_numpy(), (fits["start"] + fits["length"]).to_numpy())
            new = np.maximum.accumulate(reach)[b] < b + d + size
            b, d = b[new], d[new]
        if len(b):
            order = np.lexsort((b, d))
            b, d = b[order], d[order]
            head = np.concatenate([[True], (d[1:] != d[:-1]) | (b[1:] != b[:-1] + size) | (lot.ends[b[1:]] != lot.ends[b[:-1]])])
            last = np.concatenate([np.flatnonzero(head)[1:], [len(b)]]) - 1
            lo, hi = extended(lot, b[head], b[last] + size, d[head])
            period = d[head]
            length = hi - lo + period
            ok = length >= np.maximum(MIN_RUN, 2 * period)
            known = pd.concat([known, pd.DataFrame({"start": lo[ok], "length": length[ok], "period": period[ok]})])
            # of equal stretches the smallest distance is the period
            known = known.sort_values("period", kind="stable").drop_duplicates(["start", "length"])
        scale *= 2
    return known.sort_values(["start", "period"]).reset_index(drop=True)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each text, by start, then period."""
    lot = lot_of(texts)
    found = runs_of_lot(lot)
    bounds = np.cumsum([0] + [len(w) for w in texts])
    of = np.searchsorted(bounds, found["start"].to_numpy(), "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, s, length, q in zip(of.tolist(), found["start"].tolist(), found["length"].tolist(), found["period"].tolist()):
        out[i].append((s - int(bounds[i]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for s, length, q in runs:
        keep[s + q:s + length] = False
    return [w for w, k in zip(words, keep) if k] if runs else words


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: the tail of a tenth of the documents is made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _result(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, length, q, 1000 * length // q if q else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def lots(batches: Iterator[pd.DataFrame], change) -> Iterator[tuple[list, list[list[bytes]]]]:
    """``(ids, words)`` of about ``LOT`` words at a time; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for f in batches:
        for doc_id, text in zip(f["doc_id"].tolist(), f["text"].tolist()):
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            words = change(doc_id, (text or "").encode("utf-8", "surrogatepass").split())  # at [\x20\x09-\x0D]+
            if texts and size + len(words) > LOT:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
    if texts:
        yield ids, texts


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, period)``, one row per run of the texts as they are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in lots(batches, lambda _, words: words):
            rows = [(i, *r) for i, found in zip(ids, runs_of(texts)) for r in found]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "period"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, start long, length long, period long")


def op12_periodic_runs(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed text, per document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for ids, texts in lots(batches, planted):
            out = pd.DataFrame([_result(i, w, r) for i, w, r in zip(ids, texts, runs_of(texts))], columns=names)
            for c in ("doc_id", "start", "length", "period", "exponent_milli"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, RESULT)
