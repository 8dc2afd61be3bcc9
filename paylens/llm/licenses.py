"""License scan by template markup (operator 2).

A template is license wording with two kinds of marked regions, in the usual
matching-guideline notation::

    <<beginOptional>> words that may be missing <<endOptional>>
    <<var;name=holder;words=0-12>>   any 0 to 12 words in place of the region

``compile_template`` turns a template into an automaton over words: a literal
word is a transition, an optional region adds an empty transition around it and
a replaceable region a bounded chain of any-word transitions.  A text is
accepted at a place when every mandatory word stands there exactly, in order,
with nothing between them but what the regions allow.  Automata run only in
texts that hold the template's longest run of mandatory words, and only from
words that can start a match.

Results: a NULL text counts as empty and gives no words, places or matches.
Repeated rows give repeated results; ties between matches are ordered by start,
end and label; other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short license wording with markup; label → template.
TEMPLATES = {
    "mit-reference": "<<beginOptional>>this <<var;name=what;words=0-4>> is<<endOptional>> "
                     "<<var;name=verb;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of "
                      "<<var;name=what;words=1-8>> and associated documentation files "
                      "<<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction",
    "apache-2.0-reference": "Licensed under the Apache License, Version 2.0 "
                            "<<beginOptional>>(the \"License\")<<endOptional>> "
                            "<<beginOptional>>; you may not use <<var;name=what;words=1-4>> except in compliance "
                            "with the License<<endOptional>>",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are "
                          "permitted provided that the following conditions are met",
    "gpl-3.0-reference": "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License"
                         "<<beginOptional>>,<<endOptional>> version 3 "
                         "<<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version"
                         "<<endOptional>>",
    "gpl-header": "is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "<<var;name=kind;words=0-1>> General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-reference": "licensed under <<beginOptional>>a <<endOptional>>"
                              "<<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0 "
                              "<<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
                      "without fee is hereby granted",
}

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: on UTF-8
# bytes, a table that lower-cases letters and blanks every other ASCII byte
# but digits leaves exactly those words between blanks.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCH_SCHEMA = ("n_words bigint, base array<struct<label:string,start:bigint>>, "
                "matches array<struct<label:string,start:bigint,stop:bigint,score:double>>")


def words_of(text: str | None) -> list[bytes]:
    """The contract's words of a text, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """Word automaton of one template; state 0 starts, ``accept`` ends a match."""

    label: str
    literal: list[tuple[bytes, int] | None]  # state → (word, next state)
    any_word: list[int | None]               # state → next state on any word
    empty: list[list[int]]                   # state → states reached without a word
    accept: int
    n_literals: int
    first: set[bytes]                        # words that can start a match; empty if any word can
    needle: bytes                            # longest run of mandatory words, blank-delimited
    reach: int                               # most words of a match

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """``(stop, literal words read)`` of the longest match from ``at``."""
        state = dict.fromkeys(self.closure({0}), 0)
        best, i = None, at
        while state:
            if self.accept in state:
                best = (i, state[self.accept])
            if i >= len(words):
                break
            step: dict[int, int] = {}
            for s, read in state.items():
                lit, nxt = self.literal[s], self.any_word[s]
                if lit and lit[0] == words[i]:
                    step[lit[1]] = max(step.get(lit[1], -1), read + 1)
                if nxt is not None:
                    step[nxt] = max(step.get(nxt, -1), read)
            state = {}
            for s, read in step.items():
                for t in self.closure({s}):
                    state[t] = max(state.get(t, -1), read)
            i += 1
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Automaton of one template; unbalanced regions and unknown markup raise ``ValueError``."""
    literal: list = [None]
    any_word: list = [None]
    empty: list = [[]]

    def new() -> int:
        literal.append(None)
        any_word.append(None)
        empty.append([])
        return len(literal) - 1

    here, opened, runs, run, n_literals, n_any = 0, [], [], [], 0, 0
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            opened.append(here)
            runs, run = [*runs, run], []
        elif part == "<<endOptional>>":
            if not opened:
                raise ValueError(f"{label}: endOptional without beginOptional")
            nxt = new()
            empty[here].append(nxt)
            empty[opened.pop()].append(nxt)
            here, run = nxt, []
        elif part.startswith("<<var;"):
            bound = re.search(r"words=(\d+)-(\d+)", part)
            if not bound:
                raise ValueError(f"{label}: a var region needs words=least-most")
            least, most = int(bound[1]), int(bound[2])
            n_any += most
            end, chain = new(), here
            for k in range(most):
                if k >= least:
                    empty[chain].append(end)
                nxt = new()
                any_word[chain] = nxt
                chain = nxt
            empty[chain].append(end)
            here = end
            runs, run = [*runs, run], []
        elif part.startswith("<<"):
            raise ValueError(f"{label}: unknown markup {part}")
        else:
            for w in words_of(part):
                # a state has one literal transition: regions always open a new state
                if literal[here] is not None or any_word[here] is not None:
                    nxt = new()
                    empty[here].append(nxt)
                    here = nxt
                nxt = new()
                literal[here] = (w, nxt)
                here = nxt
                n_literals += 1
                if not opened:
                    run.append(w)
    if opened:
        raise ValueError(f"{label}: beginOptional without endOptional")
    longest = max([*runs, run], key=len)
    if not longest:
        raise ValueError(f"{label}: a template needs mandatory words")
    needle = b" " + b" ".join(longest) + b" "
    out = Automaton(label, literal, any_word, empty, here, n_literals, set(), needle, n_literals + n_any)
    start = out.closure({0})
    if all(any_word[s] is None for s in start):
        out.first = {literal[s][0] for s in start if literal[s]}
    return out


def _windows(words: list[bytes], needle: list[bytes]) -> list[int]:
    n = len(needle)
    return [i for i in range(len(words) - n + 1) if words[i] == needle[0] and words[i:i + n] == needle]


def scan_text(text: str | None, automata: list[Automaton]) -> tuple:
    """``(n_words, base places, template matches)`` of one text.

    A template is tried from every word that can start it; where any word can,
    from as many words before each place of its mandatory run as a match of the
    template can hold.
    """
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE_PHRASES.items():
        needle = phrase.encode()
        if b" " + needle + b" " in line:
            base += [{"label": label, "start": i} for i in _windows(words, needle.split())]
    matches = []
    for a in automata:
        if a.needle not in line:
            continue
        if a.first:
            starts = [i for i, w in enumerate(words) if w in a.first]
        else:
            starts = sorted({i for p in _windows(words, a.needle.split()) for i in range(max(0, p - a.reach), p + 1)})
        taken = -1
        for i in starts:
            if i < taken:
                continue
            if found := a.match(words, i):
                stop, read = found
                matches.append({"label": a.label, "start": i, "stop": stop, "score": read / a.n_literals})
                taken = stop
    base.sort(key=lambda x: (x["start"], x["label"]))
    matches.sort(key=lambda x: (x["start"], x["stop"], x["label"]))
    return len(words), base, matches


def license_matches(text: Column, templates: dict[str, str] | None = None) -> Column:
    """Struct column (``MATCH_SCHEMA``) with the phrase places and template matches of a text column."""
    automata = [compile_template(k, v) for k, v in (templates or TEMPLATES).items()]

    @F.pandas_udf(MATCH_SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_text(t, automata) for t in texts], columns=["n_words", "base", "matches"])

    return scan(text)


def license_scan(docs: DataFrame, text_col: str = "text", out: str = "licenses",
                 templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with one struct column ``out`` added (see :data:`MATCH_SCHEMA`)."""
    return docs.withColumn(out, license_matches(F.col(text_col), templates))


def op2_license_scan(docs: DataFrame) -> DataFrame:
    """Digest per document: places of the base phrases, labels and a score.

    ``score``: 1 if every word of an accepted template stood in the text, the
    share of its words otherwise; 0.5 for a base phrase alone; 0 without hits.
    """
    x = license_scan(docs.select("doc_id", "text"), out="x").select("doc_id", "x.*")
    base_labels = F.array_sort(F.array_distinct("base.label"))
    labels = F.array_sort(F.array_distinct(F.concat("base.label", "matches.label")))
    return x.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("matches.score"), F.lit(0.0)),
                   F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
