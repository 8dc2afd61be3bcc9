"""Small awkward tables shared by the operator tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string, taken string"


def docs(spark, rows):
    """A documents table of ``(doc_id, text[, source])`` rows, with extra columns whose names clash with results."""
    full = [(i, t, "en", (more[0] if more else f"src{(i or 0) % 3}"), len(t or ""), "clash", "clash", None)
            for i, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(w, share, seed):
    r = random.Random(seed)
    return [f"edit{r.randrange(10**6)}" if r.random() < share else x for x in w]


def awkward():
    """Nulls, blanks, one-word and very long texts, copies, repeated rows, rows without id, odd characters."""
    base = words(120, 1)
    long = words(12_000, 2, 5000)
    passage = words(60, 3)
    rows = [
        (None, "no id at all " + " ".join(passage)), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"),
        (5, " ".join(base)), (6, " ".join(base)), (6, " ".join(base)), (7, "  ".join(base).upper()),
        (8, " ".join(long)), (9, " ".join(long[:11_500] + words(500, 4))), (10, "é ß ſK İstanbul 東京 " * 20),
        (11, "same " * 200), (12, "same " * 100), (13, " ".join(words(50, 5) + passage)),
        (14, " ".join(passage + words(50, 6))), (15, "x" * 4_000), (16, "a b"), (17, "A  B"), (18, "b a"),
        (19, " ".join(words(40, 7)) + "\n" + " ".join(passage[:12])), (20, "\U0001f600 " * 30),
    ]
    rows += [(100 + j, " ".join(edited(base, 0.05, j))) for j in range(12)]
    rows += [(200 + j, " ".join(edited(base, 0.15, 50 + j))) for j in range(12)]
    return rows
