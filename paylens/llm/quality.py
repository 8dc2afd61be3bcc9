"""Quality classifier (operator 1): ordinal cumulative-link regression on graded ratings.

A text has one latent score ``s``, the sum of the weights of its distinct
hashed features (its words, how many words share a stem, and hashed tokens for
how it is written: symbol runs, capitals, repetition).  Ordered thresholds cut the score into grades:
``P(grade >= k) = sigmoid(s - threshold_k)``, so all grades share the weights
and the tail probabilities can never cross.  Weights and thresholds (the first one and
the logarithms of the gaps) are fitted together: first with an L1 term, which
leaves features without evidence at exactly zero, then without it on the others.

The fit uses a bounded sample of the rated rows, about ``MAX_RATED`` of them
chosen by a hash of the id.  Spark counts in how many of them each feature occurs and
drops those in fewer than ``MIN_ROWS``, however long a text is; one task fits on the
rest, until the objective no longer falls (at most ``STEPS`` steps a phase), and only
the nonzero weights reach the driver.  Scoring is one pass over all texts, whole.

Results: a NULL or blank text has no features and scores 0.  A rating with a
NULL in it is not used; without any rating, and with empty tables, every document is
accepted.  Repeated rows score alike and count once in the fit; documents with equal
scores are decided alike, at ``ACCEPT`` exactly they are accepted.  Other columns, also
ones named like the results, are untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import written

MAX_RATED = 20_000
FEATURE_BITS = 30  # wide enough that a frequent word hardly ever shares its index with a rare one
MIN_ROWS = 3       # rated rows that a feature must occur in
STEPS = 300
TOLERANCE = 1e-5   # least relative fall of the objective over CHECK_EVERY steps
CHECK_EVERY = 10
L1 = 4.0           # about the number of contradicting rows a feature has to outweigh
ACCEPT = 0.5  # least probability of the highest grade

_TAIL = re.compile(r"[^\w\s]{2,}$")


def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1)


STEM = 5  # characters of a word that stand for its stem


def word_features(word: str) -> tuple[tuple[int, ...], int]:
    """Feature indices of one distinct word as written, and the index of its stem (-1: none)."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    if not core:
        return (_hashed("mark:" + word[:8]),), -1
    out = [_hashed("word:" + core)]
    if m := _TAIL.search(word):
        out.append(_hashed("tail:" + m[0][:8]))
    return tuple(out), _hashed("stem:" + core[:STEM]) if len(core) > STEM else -1


def stem_features(stem: int) -> list[int]:
    """Indices for one, two and three distinct words of a stem."""
    return [(stem + k * 0x3779B97F) & ((1 << FEATURE_BITS) - 1) for k in range(3)]


def style_features(words: list[str]) -> list[int]:
    """Shares of capitals, bare marks, symbol tails and repeats, in tenths."""
    n = len(words)
    if n < 5:
        return []
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    marks = sum(not any(map(str.isalnum, w)) for w in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    out = []
    for name, share in (("caps", caps / n), ("marks", marks / n), ("again", again / n)):
        out += [_hashed(f"{name}>={k}") for k in range(1, int(10 * share) + 1)]
    return out


class FeatureCache(dict):
    """Word → feature indices and stem, remembering a bounded number of words."""

    def __init__(self, keep: frozenset[int] | None = None, bound: int = 500_000):
        super().__init__()
        self.keep, self.bound = keep, bound

    def __missing__(self, word: str) -> tuple[tuple[int, ...], int]:
        if len(self) >= self.bound:
            self.clear()
        own, stem = word_features(word)
        if self.keep is not None:
            own = tuple(i for i in own if i in self.keep)
            if stem >= 0 and self.keep.isdisjoint(stem_features(stem)):
                stem = -1
        out = self[word] = (own, stem)
        return out


def features(text: str | None, cache: FeatureCache) -> set[int]:
    """Distinct feature indices of a text (only those in ``cache.keep``, if set)."""
    words = (text or "").split()
    out: set[int] = set()
    stems: dict[int, int] = {}
    for w in set(words):
        own, stem = cache[w]
        out.update(own)
        if stem >= 0:
            stems[stem] = stems.get(stem, 0) + 1
    for stem, n in stems.items():
        out.update(stem_features(stem)[:n])
    out.update(style_features(words))
    return out if cache.keep is None else out & cache.keep


@dataclass
class OrdinalModel:
    """Nonzero weights by feature index and the ordered thresholds between grades."""

    weights: dict[int, float]
    thresholds: list[float]

    def score(self, idx: set[int]) -> float:
        return sum(map(self.weights.__getitem__, idx))

    def tails(self, s: float) -> list[float]:
        """``P(grade >= k)`` for k = 1 ... highest."""
        return [float(_sigmoid(s - t)) for t in self.thresholds]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class _Incidence:
    """Which row has which column, sorted both ways, so that a sum over either is one gather and one segmented sum."""

    def __init__(self, at: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int):
        """``at`` ascending, each pair once."""
        self.shape = (n_rows, n_cols)
        self.cols, self.at = cols, at[np.argsort(cols, kind="stable")]
        self.row_n, self.col_n = np.bincount(at, minlength=n_rows), np.bincount(cols, minlength=n_cols)

    def only(self, kept: np.ndarray) -> _Incidence:
        """The same rows with the kept columns, renumbered."""
        live = kept[self.cols]
        at = np.repeat(np.arange(self.shape[0]), self.row_n)[live]
        return _Incidence(at, (np.cumsum(kept) - 1)[self.cols[live]], self.shape[0], int(kept.sum()))

    @staticmethod
    def _sums(values: np.ndarray, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n))
        some = n > 0
        if len(index):
            out[some] = np.add.reduceat(np.take(values, index), (np.cumsum(n) - n)[some])
        return out

    def row_sums(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w, self.cols, self.row_n)

    def column_sums(self, r: np.ndarray) -> np.ndarray:
        return self._sums(r, self.at, self.col_n)


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, rate: float = 0.3,
             l1: float = L1, l2: float = 0.02, min_rows: int = MIN_ROWS) -> OrdinalModel:
    """Fit on feature-index rows and integer grades ``0 ... n_grades - 1``.

    Full-batch proximal AdaGrad on the penalised likelihood, which is convex in the score.
    """
    if not len(rows):
        return OrdinalModel({}, [-35.0] * (n_grades - 1))
    names, index, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    # a row moves a weight's gradient by less than 1, so in up to ``l1`` rows it never leaves zero
    often = (count >= min_rows) & (count > l1)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[often[index]]
    cols = (np.cumsum(often) - 1)[index[often[index]]]
    names = names[often]
    m = _Incidence(at, cols, len(rows), len(names))
    del index, at, cols
    w, w_sq = np.zeros(len(names)), np.full(len(names), 1e-6)

    y = np.asarray(grades, dtype=np.int64)
    seen = np.bincount(y, minlength=n_grades) + 1.0
    above = np.array([seen[k:].sum() / seen.sum() for k in range(1, n_grades)])
    theta = -np.log(above / (1 - above))  # without features: the grades' frequencies
    knots = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 0.1))])
    k_sq = np.full(len(knots), 1e-6)
    low, high = y > 0, y < n_grades - 1
    penalty, phase, step, last = l1, 0, 0, np.inf
    while True:
        if step == steps or last == -np.inf:
            if phase:
                break
            phase, step, last = 1, 0, np.inf  # the L1 term has chosen the features; now fit those without its shrinkage
            m = m.only(w != 0)
            names, w = names[w != 0], w[w != 0]
            penalty, w_sq = 0.0, np.full(len(names), 1e-6)
        theta = np.cumsum(np.concatenate([knots[:1], np.exp(knots[1:])]))
        s = m.row_sums(w)
        a, b = np.ones(len(rows)), np.zeros(len(rows))
        a[low] = _sigmoid(s[low] - theta[y[low] - 1])
        b[high] = _sigmoid(s[high] - theta[y[high]])
        p = np.maximum(a - b, 1e-9)
        if step % CHECK_EVERY == 0:
            now = -np.log(p).sum() + penalty * np.abs(w).sum() + l2 / 2 * (w * w).sum()
            last = -np.inf if abs(last - now) <= TOLERANCE * abs(now) else now
        step += 1
        # gradients of -log p: by the score, and by the thresholds on either side of the grade
        by_score = a + b - 1.0
        by_theta = (np.bincount(y[low] - 1, weights=(a * (1 - a) / p)[low], minlength=n_grades - 1)
                    - np.bincount(y[high], weights=(b * (1 - b) / p)[high], minlength=n_grades - 1))
        tail = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([tail[:1], tail[1:] * np.exp(knots[1:])])
        k_sq += g * g
        knots -= rate * g / np.sqrt(k_sq)
        g = m.column_sums(by_score) + l2 * w
        w_sq += g * g
        pace = rate / np.sqrt(w_sq)
        w = w - pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0.0)
    theta = np.cumsum(np.concatenate([knots[:1], np.exp(knots[1:])]))
    return OrdinalModel({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, theta.tolist())


def rated_features(rated: DataFrame, text_col: str, grade_col: str, id_col: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """``(h, g, x)`` per distinct rated row: a hash, its grade and its features that stand in ``min_rows`` rows."""
    @F.pandas_udf("array<int>")
    def indices(texts: pd.Series) -> pd.Series:
        cache = FeatureCache()
        return pd.Series([np.fromiter(sorted(features(t, cache)), np.int32) for t in texts], dtype=object)

    rows = rated.select(F.xxhash64(id_col, text_col).alias("h"), F.col(grade_col).cast("int").alias("g"),
                        indices(text_col).alias("x")).dropDuplicates(["h", "g"])
    rows = written(rows, "rated-features")
    each = rows.select("h", "g", F.explode("x").alias("i"))
    often = each.groupBy("i").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_rows).select("i")
    kept = each.join(often, "i").groupBy("h", "g").agg(F.sort_array(F.collect_list("i")).alias("x"))
    return rows.select("h", "g").join(kept, ["h", "g"], "left")


def fit(rated: DataFrame, n_grades: int, text_col: str = "text", grade_col: str = "grade", id_col: str = "doc_id",
        max_rated: int = MAX_RATED, steps: int = STEPS) -> OrdinalModel:
    """Fit on ``rated`` rows; about ``max_rated`` of them, by a hash of the id, if there are more."""
    rated = rated.where(F.col(grade_col).between(0, n_grades - 1))
    total = rated.count()
    if total > max_rated:
        rated = rated.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(max_rated / total * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, order = [], []
        for f in batches:
            rows += [np.asarray(x if x is not None else (), np.int32) for x in f["x"]]
            order += zip(f["g"].tolist(), f["h"].tolist())
        by = sorted(range(len(rows)), key=order.__getitem__)  # the same order on every run
        m = fit_rows([rows[i] for i in by], np.array([order[i][0] for i in by], np.int64), n_grades, steps)
        names = [-1 - k for k in range(n_grades - 1)] + list(m.weights)
        yield pd.DataFrame({"i": np.array(names, np.int64), "w": [*m.thresholds, *m.weights.values()]})

    sample = written(rated_features(rated, text_col, grade_col, id_col), "rated-sample")
    got = {r.i: r.w for r in sample.coalesce(1).mapInPandas(run, "i long, w double").collect()}
    if not got:  # an empty table has no task to fit in
        return fit_rows([], np.empty(0, np.int64), n_grades)
    return OrdinalModel({i: w for i, w in got.items() if i >= 0}, [got[-1 - k] for k in range(n_grades - 1)])


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, grade)``: 0 poor writing, 1 well written but toxic, 2 well written and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marks, "doc_id").select("doc_id", "text", grade.alias("grade"))


def assessment(text: Column, model: OrdinalModel) -> Column:
    """``struct<score, expected_grade, p_top>`` of a text column."""
    keep = frozenset(model.weights)

    @F.pandas_udf("score double, expected_grade double, p_top double")
    def assess(texts: pd.Series) -> pd.DataFrame:
        cache = FeatureCache(keep)
        s = np.array([model.score(features(t, cache)) for t in texts], dtype=float)
        tails = [_sigmoid(s - t) for t in model.thresholds]
        return pd.DataFrame({"score": s, "expected_grade": sum(tails), "p_top": tails[-1]})

    return assess(text)


def assess(docs: DataFrame, model: OrdinalModel, out: str = "assessment") -> DataFrame:
    """``docs`` with the struct column ``out`` added."""
    return docs.withColumn(out, assessment(F.col("text"), model))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose probability of the top grade reaches ``accept``."""
    model = fit(graded(docs, labels), 3)
    return docs.where(assessment(F.col("text"), model)["p_top"] >= accept)


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected grade, probability of the top grade and decision per document."""
    model = fit(graded(docs, labels), 3)
    x = assess(docs.select("doc_id", "text"), model, "a")
    return x.select("doc_id", F.col("a.expected_grade").alias("expected_grade"), F.col("a.p_top").alias("p_top"),
                    (F.col("a.p_top") >= ACCEPT).alias("accepted"))
