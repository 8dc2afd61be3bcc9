"""Secret scan (operator 6): keyword prefilter, anchored expressions, checksums.

One Aho-Corasick automaton holds every keyword.  A text is passed through it
once; an anchored expression runs only where one of its keywords stands.  The
``hex`` kind has no keyword, so a run scan finds it.  Token formats that embed
a checksum are kept only when it holds:

* ``github`` and ``npm``: a prefix, 30 base-62 characters and the base-62
  CRC-32 of those characters in the last six;
* ``pem``: a private-key block whose base64 body decodes to a DER sequence
  with exactly the length it states.

Results: a NULL text counts as empty and has no spans.  Offsets are code
points, end exclusive.  Spans of one kind never overlap; spans of different
kinds may.  Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's kinds, keywords and expressions.
BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("github", "npm", "pem")
_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: a run that is too short is skipped, as by matching and dropping
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github",
    "ghr_": "github", "npm_": "npm", "-----begin ": "pem",
}

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPAN_SCHEMA = "array<struct<kind:string,start:bigint,stop:bigint>>"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def der_length_holds(body: str) -> bool:
    """Whether a base64 body is one DER sequence of exactly the length in its header."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return 0 < n <= 4 and len(raw) == 2 + n + int.from_bytes(raw[2:2 + n], "big")


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind == "pem":
        return der_length_holds(m[1])
    return base62_crc(m[1]) == m[2]


_EXPR = {"assign": _ASSIGN, "access": _ACCESS, "github": _GITHUB, "npm": _NPM, "pem": _PEM}


def keyword_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, kind in KEYWORDS.items():
        a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    low = text.lower()
    if len(low) == len(text):
        return low
    # a few letters grow when lower-cased; fold ASCII alone to keep offsets
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def scan_text(text: str | None, automaton: ahocorasick.Automaton) -> list[dict]:
    """Spans of one text, by start, then kind as listed."""
    if not text:
        return []
    spans = [("hex", *m.span()) for m in _HEX.finditer(text)]
    hits: dict[str, set[int]] = {}
    for end, (n, kind) in automaton.iter(_folded(text)):
        hits.setdefault(kind, set()).add(end - n + 1)
    for kind, starts in hits.items():
        free = 0  # a match that fails its check still uses up its text
        for at in sorted(starts):
            if at >= free and (m := _EXPR[kind].match(text, at)):
                free = m.end()
                if _accept(kind, m):
                    spans.append((kind, *m.span()))
    order = BASE_KINDS + METHOD_KINDS
    spans.sort(key=lambda s: (s[1], order.index(s[0])))
    return [{"kind": k, "start": a, "stop": b} for k, a, b in spans]


def secret_spans(text: Column) -> Column:
    """Array of ``(kind, start, stop)`` for a text column."""

    @F.pandas_udf(SPAN_SCHEMA)
    def scan(texts: pd.Series) -> pd.Series:
        automaton = keyword_automaton()
        return pd.Series([scan_text(t, automaton) for t in texts], dtype=object)

    return scan(text)


def secret_scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the array column ``out`` of secret spans added."""
    return docs.withColumn(out, secret_spans(F.col(text_col)))


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    """Counts of base spans, a digest of them and all spans, per document."""
    x = secret_scan(docs.select("doc_id", "text"), out="s").select("doc_id", "s")
    base = F.filter("s", lambda e: e["kind"].isin(*BASE_KINDS))
    line = lambda spans: F.array_join(
        F.transform(spans, lambda e: F.concat_ws(":", e["kind"], e["start"], e["stop"])), ",")
    count = lambda k: F.size(F.filter("s", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return x.select("doc_id", *[count(k) for k in BASE_KINDS],
                    F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("s")).alias("spans"))
