"""Spelling variants: vocabulary words that differ by one edit (operator 13).

*Vocabulary.*  Words and their counts come from one grouped aggregation over the
texts with partial sums in every task; a word that stands in every document sends
one row per task.

*Lists.*  A pair one edit apart whose shorter word has c code points agrees in the
first ``c // 2`` of them or in the last ``c - c // 2``: the edit is behind the middle
or before it.  So every word joins four lists, by its head and by its tail, once as
the shorter word (c its length) and once as the longer one (c its length less one).
Spark deals the lists to tasks by key and sorts them; tails are written backwards, so
that the words of a list always share a prefix.  A pair is counted in the list of its
heads, and in that of its tails only if the heads differ.  A list of more than
``LIST_MAX`` words is cut into parts by a hash of the word; each pair of parts is then
a list of its own, so that no task holds a list of unbounded size.

*Scan.*  In a sorted list the words with a common prefix are one range, found from the
longest common prefixes (LCP) of neighbours.  For all words of a list at once, the
rows of the edit matrix (banded: three cells around the diagonal) go down from range
to range: a row is computed once per distinct prefix and shared by every word behind
it, and a range whose row exceeds one edit in all cells is skipped whole.  Each list
is held with its words as one matrix of code points, ``ROWS`` words (and the rest of
the list that goes over) at a time.

Each list gives one row per word: its near words' number and the best of them, so
pairs never leave a task.  Forms and roots follow from these by joins on the
vocabulary; as a form counts at least twice its word, roots are found in as many
doublings as the logarithm of the logarithm of the largest count.

Results.  NULL, empty and blank texts hold no words; a row without ``doc_id`` drops no
code point; repeated rows count as often as they stand there.  Ties for the form go to
the smaller word in code-point order.  An empty table gives no rows, extra columns are
not read, and texts and words of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import lower_ascii, written

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LETTERS, MIN_COUNT, DROP = 5, 3, 97
LIST_MAX = 50_000
ROWS = 1 << 16
FRONT = 1 << 20  # edit-matrix rows worked on at once


def with_drops(doc_id: Column, word: Column) -> Column:
    """The contract's change: a pseudorandom one in ``DROP`` occurrences loses a code point."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    k = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.char_length(word)))
    return F.when(h % DROP == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, drops: bool = True) -> DataFrame:
    """``(word, n)`` of the letter runs of ``(doc_id, text)`` that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    # a run shorter than the limit stays too short, whatever it loses
    runs = runs.where(F.char_length("run") >= min_letters)
    word = with_drops(F.col("doc_id"), F.col("run")) if drops else F.col("run")
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def lists(words: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """``(key, part, role, shown, skip, head, word, n)``: the words of every list.

    ``shown`` is the word as the list sorts it, ``skip`` the length of the prefix that the
    list shares, ``role`` 1: looks for near words, 2: is looked at, 3: both.
    """
    size = F.char_length("word")
    backwards = F.reverse("word")

    def entry(kind: str, c: Column) -> Column:
        h = F.floor(c / 2).cast("int")
        if kind == "head":
            shown, skip = F.col("word"), h
        else:
            shown, skip = backwards, c - h
        key = F.concat_ws(" ", F.lit(kind), c, F.substring(shown, F.lit(1), skip))
        return F.struct(key.alias("key"), shown.alias("shown"), skip.alias("skip"), c.alias("c"))

    entries = [entry(kind, size - d) for d in (0, 1) for kind in ("head", "tail")]
    rows = words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select("e.*", "word", "n")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    rows = rows.join(sizes, "key").withColumn("parts", F.ceil(F.col("held") / list_max).cast("int")).drop("held")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # parts = 1: one list.  Else one list for each pair of parts: rows of the pair look, columns are looked at
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                       lambda i: F.struct((own * F.col("parts") + i).alias("part"), F.when(i == own, 3).otherwise(1).alias("role")))
    seen = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                       lambda i: F.struct((i * F.col("parts") + own).alias("part"), F.lit(2).alias("role")))
    cells = F.concat(asks, F.filter(seen, lambda x: x["part"] != own * F.col("parts") + own))
    return rows.withColumn("cell", F.explode(cells)).select(
        "key", F.col("cell.part").alias("part"), F.col("cell.role").alias("role"), "shown", "skip", "c", "n")


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of the words, zero behind their ends."""
    return np.array(words, dtype=f"U{max(map(len, words)) + 2}").view(np.uint32).reshape(len(words), -1)


def near_pairs(group: np.ndarray, words: list[str], skip: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(asking row, near row)`` of words one edit apart in one group; rows are sorted by group, then word.

    The words of a group share their first ``skip`` code points.
    """
    m = _matrix(words)
    n, width = m.shape
    size = (m != 0).sum(axis=1)
    same_group = group[1:] == group[:-1]
    lcp = np.where(same_group, (m[1:] != m[:-1]).argmax(axis=1), -1)
    lcp[same_group & (m[1:] == m[:-1]).all(axis=1)] = width
    first = np.flatnonzero(np.append(True, ~same_group))
    of_group = np.searchsorted(first, np.arange(n), "right") - 1
    bounds = np.append(first, n)
    asking = np.flatnonzero(asks)
    # a front of (asking word q, range [lo, hi) of words that share k letters, three cells of matrix row k)
    waiting = [(0, asking[i:i + FRONT // 8], None) for i in range(0, len(asking), FRONT // 8)]
    while waiting:
        k, q, state = waiting.pop()
        if state is None:
            lo, hi = bounds[of_group[q]], bounds[of_group[q] + 1]
            cells = np.tile(np.array([2, 0, 1], np.int8), (len(q), 1))  # columns k - 1, k, k + 1
        else:
            lo, hi, cells = state
        while len(q):
            # the ranges sharing k + 1 letters inside each range
            cut = np.flatnonzero(np.append(True, lcp <= k)) if n > 1 else np.zeros(1, np.int64)
            a, b = np.searchsorted(cut, lo), np.searchsorted(cut, hi)
            count = b - a
            which = np.repeat(np.arange(len(q)), count)
            at = cut[np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))]
            stop = np.append(cut, n)[np.searchsorted(cut, at) + 1]
            q, cells, letter = q[which], cells[which], m[at, min(k, width - 1)] if k < width else np.zeros(len(at), np.uint32)
            ended = letter == 0
            if ended.any():  # a word of k letters ends here: its distance is in the column of the asking word's length
                e = np.flatnonzero(ended)
                gap = size[q[e]] - k
                near = (np.abs(gap) <= 1) & (cells[e, np.clip(gap + 1, 0, 2)] == 1)
                if near.any():
                    e = e[near]
                    # equal words share a range; a list may hold one twice
                    reps = stop[e] - at[e]
                    rows = np.repeat(at[e] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                    yield np.repeat(q[e], reps), rows
            go = ~ended
            q, lo, hi, cells, letter = q[go], at[go], stop[go], cells[go], letter[go]
            k += 1
            # row k from row k - 1: columns k - 1, k, k + 1 of the asking word's letters k - 2, k - 1, k
            mine = [m[q, j] if 0 <= j < width else np.zeros(len(q), np.uint32) for j in (k - 2, k - 1, k)]
            new = np.empty_like(cells)
            new[:, 0] = np.minimum(cells[:, 0] + ((mine[0] != letter) | (k < 2)), cells[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(cells[:, 1] + (mine[1] != letter), cells[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(cells[:, 2] + (mine[2] != letter), new[:, 1] + 1)
            new[:, 2][k + 1 > size[q]] = 2
            new[:, 1][k > size[q]] = 2
            new[:, 0][k - 1 > size[q]] = 2
            np.minimum(new, 2, out=new)
            live = new.min(axis=1) <= 1  # otherwise the range is skipped
            q, lo, hi, cells = q[live], lo[live], hi[live], new[live]
            if len(q) > FRONT:
                half = len(q) // 2
                waiting.append((k, q[half:], (lo[half:], hi[half:], cells[half:])))
                q, lo, hi, cells = q[:half], lo[:half], hi[:half], cells[:half]


def _partial(f: pd.DataFrame) -> pd.DataFrame:
    """Near words' number and best of every asking word of the lists in ``f`` (whole and sorted)."""
    shown, n, role = f["shown"].tolist(), f["n"].to_numpy(), f["role"].to_numpy()
    group = f.groupby(["key", "part"], sort=False).ngroup().to_numpy()
    head = f["key"].str.startswith("head").to_numpy()
    c, m = f["c"].to_numpy(), _matrix(shown)
    size = (m != 0).sum(axis=1)
    qs, rs = [], []
    for q, r in near_pairs(group, shown, f["skip"].to_numpy(), (role & 1) > 0):
        keep = ((role[r] & 2) > 0) & (np.minimum(size[q], size[r]) == c[q])
        q, r = q[keep], r[keep]
        tails = np.flatnonzero(~head[q])
        if len(tails):  # heads that agree, too: the pair is counted there
            a, b = q[tails], r[tails]
            differ = np.zeros(len(tails), bool)
            for j in range(int((c[a] // 2).max())):  # backwards: the head's letters are the last ones
                differ |= (j < c[a] // 2) & (m[a, size[a] - 1 - j] != m[b, size[b] - 1 - j])
            keep = np.ones(len(q), bool)
            keep[tails[~differ]] = False
            q, r = q[keep], r[keep]
        qs.append(q)
        rs.append(r)
    q, r = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (qs, rs))
    word = np.array([w if h else w[::-1] for w, h in zip(shown, head)], dtype=object)
    pairs = pd.DataFrame({"word": word[q], "near": word[r], "n": n[r]})
    pairs = pairs.sort_values(["word", "n", "near"], ascending=[True, False, True])
    out = pairs.groupby("word", sort=False).agg(n_near=("near", "size"), best=("near", "first"), best_n=("n", "first"))
    return out.reset_index()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole lists of a sorted partition, many small ones at a time."""
    held: list[pd.DataFrame] = []
    for f in batches:
        if not len(f):
            continue
        held.append(f)
        if sum(map(len, held)) < ROWS:
            continue
        f = pd.concat(held, ignore_index=True)
        last = (f["key"] == f["key"].iloc[-1]) & (f["part"] == f["part"].iloc[-1])
        if not last.all():  # the last list may go on
            yield _partial(f[~last].reset_index(drop=True))
        held = [f[last]]
    if held:
        yield _partial(pd.concat(held, ignore_index=True))


def near_words(words: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """``(word, n_near, best, best_n)`` of each of ``(word, n)`` that has words one edit away.

    ``best`` is the near word of largest ``n`` (ties: the smallest).
    """
    dealt = lists(words, list_max).repartition("key", "part").sortWithinPartitions("key", "part", "shown")
    found = dealt.mapInPandas(_scan, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def spelling_groups(words: DataFrame, list_max: int = LIST_MAX) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a vocabulary ``(word, n)`` of distinct words."""
    words = written(words.select("word", "n"), "vocabulary", release=True)
    near = near_words(words, list_max)
    x = words.join(near, "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    x = written(x.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    ways = x.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the length of the way
        on = ways.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        ways = written(ways.join(on, ways["root"] == on["_at"], "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = ways.where("moved").limit(1).count()
        ways = ways.select("word", "root")
        if not moved:
            break
    return x.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(docs: DataFrame) -> DataFrame:
    """Variant groups of the documents' vocabulary."""
    return spelling_groups(vocabulary(docs.select("doc_id", "text")))
