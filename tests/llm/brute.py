"""Plain-Python versions of the operators' contracts, written from their definitions."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def licenses(text):
    """n_words, n_base, first, last, base_labels."""
    words = LICENSE_WORD.findall(lower(text))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
                          ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for _, x in found})))


def sources(rows, cap=3):
    """source → (size, target) by resharing until no source is above its cap."""
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > cap * size[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = float(cap * size[s])
        rest -= sum(target[s] for s in over)
        free -= over
    return {s: (size[s], target[s]) for s in order}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"),
     lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def pii(text):
    """Base spans (kind, start, end), by kind as listed, then start."""
    return [(k, *m.span()) for k, r, ok in PII for m in r.finditer(text or "") if ok(m[0])]


SECRETS = (
    ("assign", re.compile(r"(?a:((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                          r"([A-Za-z0-9+/_.=-]+))"), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secrets(text):
    """Base spans by start, then kind as listed."""
    spans = [(m.start(), i, k, m.end()) for i, (k, r, ok) in enumerate(SECRETS)
             for m in r.finditer(text or "") if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def substring(rows, k=13):
    """(doc_id, n_words, n_removed, kept_sha256) per row (doc_id, text); rows without id stay whole."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - k + 1):
                key = tuple(w[p:p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - k + 1):
                if first[tuple(w[p:p + k])] < i:
                    gone.update(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text, n=2):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n=2, percent=80):
    """(doc_id, n_shingles, component_id, kept) per row (doc_id, text), by an inverted index over all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    live = [(i, frozenset(s)) for i, s in sets if i is not None and s]
    parent = {i: i for i, _ in live}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    same = defaultdict(list)
    for i, s in live:
        same[s].append(i)
    for ids in same.values():
        for i in ids:
            join(i, ids[0])
    uniq = list(same)
    freq = defaultdict(int)
    for s in uniq:
        for x in s:
            freq[x] += 1
    index = defaultdict(list)
    for j, s in enumerate(uniq):  # prefix filter on rare shingles: exact
        order = sorted(s, key=lambda x: (freq[x], x))
        near = set()
        for x in order[:len(s) - math.ceil(percent * len(s) / 100) + 1]:
            near.update(index[x])
            index[x].append(j)
        for i in near:
            both = len(s & uniq[i])
            if 100 * both >= percent * (len(s) + len(uniq[i]) - both):
                join(same[s][0], same[uniq[i]][0])
    return [(i, len(s), find(i) if i is not None and s else i, i is None or not s or find(i) == i) for i, s in sets]


def neighbours(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) rows."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % every == 0:
            score = [(-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(score)[:k], 1)]
    return out


def contained(docs, items, n=5, percent=80):
    """(doc_id, item_id, shared, size) for items with at least ``percent`` of their shingles in a document."""
    def words(t):
        return LICENSE_WORD.findall((t or "").lower())

    def grams(w):
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    out, item_sets = [], [(i, grams(words(t))) for i, t in items]
    for d, t in docs:
        s = grams(words(t))
        for i, g in item_sets:
            if g and 100 * len(s & g) >= percent * len(g):
                out.append((d, i, len(s & g), len(g)))
    return out


def pairs(x):
    return itertools.combinations(x, 2)


def article(page):
    """Text of the given pages' article: its markup is known (article, h1, p, b, br)."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", inner))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def tail_made_periodic(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return list(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words):
    """All runs (start, length, period) by trying every period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    words = tail_made_periodic(doc_id, WORD.findall(text or ""))
    found = runs(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return (doc_id, len(found), s, m, q, 1000 * m // q if q else None, sha(lines),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def vocabulary(rows):
    count = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling(count):
    """word → (word, form, root, n, n_near, form_n) by comparing all pairs."""
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out
