"""Repeated-passage removal by De Bruijn compaction (operator 8).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Every run of ``K`` words (a token
k-mer) is an edge of a De Bruijn graph whose nodes are the runs of ``K - 1``
words; the graph that matters holds the edges that occur in several documents.

1. *Equal texts.*  Documents with the same word sequence collapse to the one
   with the smallest id; the others are decided by it.
2. *Sieve.*  Each k-mer is represented by its minimizer, the smallest of the
   hashes of its ``M``-word runs.  Equal k-mers have equal minimizers, so a
   k-mer whose minimizer occurs in one text only cannot repeat.  Only about
   2 / (K - M + 2) of a text's runs are minimizers of its k-mers, so this
   first shuffle is a fraction of the input.
3. *Edges.*  The k-mers that pass are grouped by a 96-bit hash: first document
   and a colour, the sum over all occurrences of a hash of the document.
4. *Paths.*  Two edges that follow each other in a document and agree in first
   document and colour are walked by the same documents the same number of
   times, so the node between them does not branch: occurrences join the
   edges and merge with their predecessors into nonbranching paths.
5. *Spans.*  A path walked by a later document than its first is a repeated
   span and is cut.  It is joined to the path of its source document for its
   coordinates; the result does not depend on them, and no words are compared.

Results: a NULL text has no words; a row without ``doc_id`` is neither a source
nor changed; rows that repeat a ``doc_id`` do not remove each other's words,
and an identical row gets an identical result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.common import written
from paylens.llm.hashing import WordHash, distinct, grams, sliding_min

K = 13  # words of a window
M = 7   # words of a minimizer
MAX_BROADCAST_ROWS = 1_000_000  # document keys, 16 bytes each


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _words(text: str | None) -> list[bytes]:
    return _bytes(text).split()


def _key(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _minimizers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """Minimizer of every k-mer."""
    return sliding_min(grams(h, m, 1), k - m + 1)


def texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, t1, t2, n_words, sha256)``: key and digests of each row's words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, t in zip(b["doc_id"], b["row"], b["text"]):
                w = _words(t)
                out.append((i, r, *_key(w), len(w), hashlib.sha256(b" ".join(w)).hexdigest()))
            f = pd.DataFrame(out, columns=["doc_id", "row", "t1", "t2", "n_words", "sha256"])
            f["doc_id"] = f["doc_id"].astype("Int64")
            yield f

    return docs.mapInPandas(run, "doc_id long, row long, t1 long, t2 long, n_words long, sha256 string")


def minimizers(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``(mini, doc_id, row)``: distinct minimizers of each row's k-mers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            mini, ids, keys = [], [], []
            for i, r, t in zip(b["doc_id"], b["row"], b["text"]):
                h = hashes.of(_bytes(t))
                if len(h) >= k:
                    u = _minimizers(h, k, m)
                    u = distinct(u[np.append(True, u[1:] != u[:-1])]).view(np.int64)
                    mini.append(u)
                    ids.append(np.full(len(u), i, np.int64))
                    keys.append(np.full(len(u), r, np.int64))
            if mini:
                yield pd.DataFrame({"mini": np.concatenate(mini), "doc_id": np.concatenate(ids),
                                    "row": np.concatenate(keys)})

    return docs.where("doc_id is not null").mapInPandas(run, "mini long, doc_id long, row long")


def kmers(hit: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``(h1, h2, doc_id, row, pos)``: the k-mers whose minimizer is in the row's ``minis``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, r, t, minis in zip(b["doc_id"], b["row"], b["text"], b["minis"]):
                h = hashes.of(_bytes(t))
                at = np.flatnonzero(np.isin(_minimizers(h, k, m).view(np.int64), minis))
                for c, v in zip(cols, (grams(h, k, 2)[at].view(np.int64), grams(h, k, 3)[at].astype(np.uint32).view(np.int32),
                                       np.full(len(at), i, np.int64), np.full(len(at), r, np.int64),
                                       at.astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield pd.DataFrame(dict(zip(("h1", "h2", "doc_id", "row", "pos"), map(np.concatenate, cols))))

    return hit.mapInPandas(run, "h1 long, h2 int, doc_id long, row long, pos int")


def edges(occurrences: DataFrame) -> DataFrame:
    """Repeated edges ``(h1, h2, src_doc, colour)``: first document and colour, 32 bits of it."""
    e = occurrences.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("_last"),
        F.sum(F.expr("xxhash64(doc_id) % 1000000007L")).alias("colour"))
    return e.where("src_doc < _last").select("h1", "h2", "src_doc", F.hash("colour").alias("colour"))


def paths(occurrences: DataFrame, e: DataFrame, k: int = K) -> DataFrame:
    """``(doc_id, row, start, stop, src_doc, path)``: the nonbranching paths that each document walks.

    Edges are joined to their predecessor by coordinate: while the first document
    and colour stay the same, every document that walks one edge walks the
    next, so the node between them does not branch.  ``start`` and ``stop``
    (exclusive) are words; ``path`` names the path by 32 bits of its
    first edge, enough within a document.
    """
    line = W.partitionBy("doc_id", "row").orderBy("pos")
    same = lambda c: F.lag(c).over(line) == F.col(c)
    on = (F.lag("pos").over(line) == F.col("pos") - 1) & same("src_doc") & same("colour")
    x = occurrences.join(e, ["h1", "h2"]).drop("h1")
    x = x.withColumn("_new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("doc_id", "row", "_run").agg(
        F.min("pos").alias("start"), (F.max("pos") + k).alias("stop"), F.first("src_doc").alias("src_doc"),
        F.max(F.when(F.col("_new") == 1, F.col("h2"))).alias("path")).drop("_run")


def verified_spans(p: DataFrame) -> DataFrame:
    """Paths walked again after their first document, with the source coordinates.

    ``(doc_id, row, start, stop, src_doc, src_start, confirmed)``: ``confirmed`` if the
    source document walks the same path over the same number of words; for
    inspection only, :func:`remove_repeats` cuts every span.
    """
    src = p.where("doc_id = src_doc").groupBy("doc_id", "path").agg(
        F.min("start").alias("src_start"), F.max(F.col("stop") - F.col("start")).alias("src_length"))
    again = p.where("doc_id > src_doc")
    x = again.join(src.withColumnRenamed("doc_id", "src_doc"), ["src_doc", "path"], "left")
    return x.select("doc_id", "row", "start", "stop", "src_doc", "src_start",
                    F.coalesce(F.col("src_length") >= F.col("stop") - F.col("start"), F.lit(False)).alias("confirmed"))


def _without(hit: DataFrame) -> DataFrame:
    """``(doc_id, row, n_removed, kept_sha256, kept)`` of rows with ``text`` and word ``cuts``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, r, t, cuts in zip(b["doc_id"], b["row"], b["text"], b["cuts"]):
                w = _words(t)
                keep = np.ones(len(w), bool)
                for c in cuts:
                    keep[c["start"]:c["stop"]] = False
                kept = b" ".join([w[j] for j in np.flatnonzero(keep)])
                out.append((i, r, int(len(w) - keep.sum()), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "row", "n_removed", "kept_sha256", "kept"])

    return hit.mapInPandas(run, "doc_id long, row long, n_removed long, kept_sha256 string, kept string")


def sieve_hits(docs: DataFrame, rows: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """``(doc_id, row, text, minis)``: first texts with minimizers that another text has too."""
    mini = minimizers(docs, k, m)
    shared = mini.groupBy("mini").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("mini")
    shared = written(shared, "shared-minimizers", release=True)
    minis = mini.join(shared, "mini").groupBy("doc_id", "row").agg(F.collect_set("mini").alias("minis"))
    first = rows.where((F.col("n_words") >= k) & (F.col("doc_id") == F.col("first_doc"))).select("doc_id", "row").distinct()
    minis = written(minis.join(first, ["doc_id", "row"]), "minimizers", release=True)
    # only these texts are needed again: send their keys to the texts while they are few
    keys = minis.select("doc_id", "row")
    if keys.count() <= MAX_BROADCAST_ROWS:
        docs = docs.join(F.broadcast(keys), ["doc_id", "row"], "left_semi")
    return docs.join(minis, ["doc_id", "row"])


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(all rows, documents with sieve hits, repeated spans)`` of ``(doc_id, text)`` rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    rows = texts(docs)
    rows = written(rows, "texts")
    first = rows.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("first_doc"))
    rows = rows.join(first, ["t1", "t2"], "left")
    hit = written(sieve_hits(docs, rows, k, m), "hits", release=True)
    found = kmers(hit, k, m)
    repeated = written(edges(found), "edges", release=True)
    walked = written(paths(found, repeated, k), "paths", release=True)
    return rows, hit, verified_spans(walked)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows, hit, cut = repeated_spans(docs, k, m)
    cuts = cut.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    done = _without(hit.select("doc_id", "row", "text").join(cuts, ["doc_id", "row"])).drop("kept").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.join(done, ["doc_id", "row"], "left")
    copy = (F.col("doc_id") > F.col("first_doc")) & (F.col("n_words") >= k)
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))


def op8_substring_dedup(docs: DataFrame) -> DataFrame:
    """Words left after removing 13-word windows seen in an earlier document."""
    return remove_repeats(docs)
