"""Language identification by Bayesian evidence fusion (operator 5).

A page offers four kinds of evidence, combined as log probabilities per language:

* *text*: a multinomial model over character trigrams of the visible text,
  trained on documents of known language.  Trigrams overlap, so their sum is
  tempered by ``TEMPER``;
* *markup*: the language that the page declares (``<html lang=...>``);
* *address*: the suffix of the host name;
* *host*: the prior of the page's host, smoothed towards its site's (the last two
  labels), which is smoothed towards that of all pages.

How far a declaration or suffix can be trusted, and every prior, are counted by
grouped aggregation over all pages from the language that the text alone
suggests; a page's own count is taken out of its priors.  Only the trigram
model is fitted on a bounded sample of documents (``MAX_PER_LANGUAGE`` rows per
language, chosen by a hash of the id); its counts are bounded by languages times
``BUCKETS``.

Results: a page without text has no text evidence and takes part in no count; a
NULL or odd address has the empty host, which is smoothed like any other; a page
without any evidence gets the prior of all pages.  Ties go to the first language
in code-point order.  If no document has a language, the language is NULL.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import written

MAX_PER_LANGUAGE = 3000
BUCKETS = 1 << 14
TEMPER = 0.3
STRENGTH = 8.0  # pages that a prior counts for one level down
MIN_TEXT = 20   # trigrams below which the text alone decides nothing

_UNSEEN = re.compile(r"<(script|style|noscript|template)\b", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "noscript", "template")}
_OPENING = re.compile(r"<html\b[^>]*", re.I)
_DECLARED = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible_text(page: str | None) -> str:
    """The text between tags, without comments and what a browser does not show, in one forward scan.

    A comment, script or the like without an end reaches to the end of the page, a '<' without '>' is text.
    """
    page, out, at = page or "", [], 0
    while (lt := page.find("<", at)) >= 0:
        out += [page[at:lt], " "]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
        elif m := _UNSEEN.match(page, lt):
            end = _ENDS[m[1].lower()].search(page, m.end())
            at = len(page) if end is None else end.end()
        else:
            end = page.find(">", lt)
            if end < 0:
                at = lt
                break
            at = end + 1
    out.append(page[at:])
    return entities.unescape("".join(out))


def declared_language(page: str | None) -> str:
    """Language in the first ``<html ...>`` tag that declares one, wherever it stands; empty if none does.

    Each tag is searched on its own, so the time is linear in the page.
    """
    for tag in _OPENING.finditer(page or ""):
        m = _DECLARED.search(tag[0], 5)
        if m:
            return m[1].lower()
    return ""


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed character trigrams of the letters, lower-cased; other runs count as one blank."""
    clean = re.sub(r"[\W\d_]+", " ", text.lower())
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)


def host_of(url: str | None) -> tuple[str, str, str]:
    """Host name (without ``www.`` and ``m.``), its site (last two labels) and its suffix; empty if there is none."""
    m = _HOST.match(url or "")
    if not m:
        return "", "", ""
    host = re.sub(r"^(www|m)\.", "", m[1].lower())
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def trigram_model(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed log probabilities of trigram buckets, from ``(doc_id, text, lang)``."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, max_per_language / n) * (1 << 30))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                sums[lang] = sums.get(lang, 0) + trigrams(text)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": v[at]})

    counts = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    table = np.full((len(langs), BUCKETS), 0.1)
    np.add.at(table, (counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int),
                      counts["bucket"].to_numpy(int)), counts["n"].to_numpy(float))
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``(page_id, host, site, suffix, declared, text_ll, text_lang)``; ``text_lang`` is NULL for too little text."""
    small = model.astype(np.float32)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, url, page in zip(b["page_id"], b["url"], b["html"]):
                v = trigrams(visible_text(page))
                ll = (small @ v.astype(np.float32)).astype(float) * TEMPER if langs else np.zeros(0)
                ll = ll - ll.max() if len(ll) else ll
                out.append((i, *host_of(url), declared_language(page), ll,
                            langs[int(ll.argmax())] if langs and v.sum() >= MIN_TEXT else None))
            f = pd.DataFrame(out, columns=["page_id", "host", "site", "suffix", "declared", "text_ll", "text_lang"])
            f["page_id"] = f["page_id"].astype("Int64")
            yield f

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(
        read, "page_id long, host string, site string, suffix string, declared string, text_ll array<double>, text_lang string")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(page_id, host, text_lang, declared, lang, posterior)`` per page."""
    langs, model = trigram_model(docs)
    seen = written(page_evidence(pages, langs, model), "page-evidence")
    if not langs:
        return seen.select("page_id", "host", "text_lang", "declared", F.lit(None).cast("string").alias("lang"),
                           F.lit(None).cast("double").alias("posterior"))
    votes = seen.where("text_lang is not null")
    each = lambda make: F.array(*[make(x) for x in langs])
    votes_for = lambda x: F.sum((F.col("text_lang") == x).cast("double"))

    def counts(*by: str) -> DataFrame:
        return votes.groupBy(*by).agg(each(votes_for).alias("_n"))

    by_declared = counts("declared").withColumnRenamed("_n", "declared_n")
    by_suffix = counts("suffix").withColumnRenamed("_n", "suffix_n")
    by_site = counts("site").withColumnRenamed("_n", "site_n")
    by_host = counts("host").withColumnRenamed("_n", "host_n")
    all_n, n_declared, n_suffix = votes.agg(each(votes_for), F.countDistinct("declared"), F.countDistinct("suffix")).first()
    all_n = [n or 0.0 for n in all_n]

    x = (seen.join(by_host, "host", "left").join(by_site, "site", "left").join(by_suffix, "suffix", "left")
         .join(by_declared, "declared", "left"))
    none = F.array(*[F.lit(0.0)] * len(langs))
    own = each(lambda l: (F.coalesce(F.col("text_lang") == l, F.lit(False))).cast("double"))
    x = x.withColumn("_own", own)
    for c in ("host_n", "site_n", "suffix_n", "declared_n"):
        x = x.withColumn(c, F.coalesce(c, none))
    top = F.array(*[F.lit(float(n)) for n in all_n])

    def less(c: Column, i: int) -> Column:  # counts without the page itself
        return F.get(c, F.lit(i)) - F.get("_own", F.lit(i))

    def size(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, b: a + b) - F.aggregate("_own", F.lit(0.0), lambda a, b: a + b)

    x = x.withColumn("_a", size(top)).withColumn("_s", size(F.col("site_n"))).withColumn("_h", size(F.col("host_n")))
    scores = []
    for i in range(len(langs)):
        base = (less(top, i) + 1.0) / (F.col("_a") + len(langs))
        site = (less(F.col("site_n"), i) + STRENGTH * base) / (F.col("_s") + STRENGTH)
        host = (less(F.col("host_n"), i) + STRENGTH * site) / (F.col("_h") + STRENGTH)
        said = (less(F.col("declared_n"), i) + 0.5) / (less(top, i) + 0.5 * (n_declared + 1))
        where = (less(F.col("suffix_n"), i) + 0.5) / (less(top, i) + 0.5 * (n_suffix + 1))
        scores.append(F.get("text_ll", F.lit(i)) + F.log(host) + F.when(F.col("declared") != "", F.log(said)).otherwise(0.0)
                      + F.when(F.col("suffix") != "", F.log(where)).otherwise(0.0))
    x = x.withColumn("_p", F.array(*scores))
    best = F.array_max("_p")
    x = x.withColumn("_at", F.array_position("_p", best).cast("int"))
    odds = F.aggregate("_p", F.lit(0.0), lambda a, s: a + F.exp(s - best))
    return x.select("page_id", "host", "text_lang", "declared",
                    F.element_at(F.array(*[F.lit(l) for l in langs]), F.col("_at")).alias("lang"),
                    (1.0 / odds).alias("posterior"))


def op5_language(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every page, with the evidence and the posterior probability."""
    return identify(pages, docs)
