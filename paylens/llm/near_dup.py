"""MinHash near-duplicate detection with fast similarity sketches (operator 10).

*Sketch.*  ``T`` coordinates are filled in rounds.  In each of the first ``T``
rounds every shingle of a document is hashed to one coordinate and a value; in
round ``T + j`` all shingles are hashed to coordinate ``j``.  A coordinate keeps
the smallest (round, value) it has seen and rounds stop as soon as none is
empty, so a set of n shingles takes about ``n + T log T`` steps, every
coordinate is filled, two sketches agree in a coordinate with probability equal
to the sets' Jaccard similarity, and their agreement concentrates around it.

*Candidates.*  ``BANDS`` bands of ``ROWS`` coordinates: documents that agree on
a whole band share a bucket.  At similarity 0.8 two sets share no bucket with
probability (1 - 0.8^5)^40, about 1e-7.

*Links without all pairs.*  Equal sets collapse to one node first.  Each bucket
compares its nodes with one pseudorandom hub; pairs whose full shingle sets pass
are links, and connected components are taken.  A bucket that lies in one
component has no more to tell.  In the others, sets are described by what they
differ in from the bulk of their hub's group (:func:`differences`): first those that
are certain to be alike are linked with the group's centre, then nodes outside the
hub's component are compared with the nodes of other components that exact bounds
leave (:func:`rare_pairs`), and components are taken again.  So every pair of a bucket
is compared on its full sets, or already connected, or excluded by an exact
bound, or its sketches exclude the threshold by about seven standard deviations.

Results: words are lower-cased A-Z and split at white space; a document's set
is its distinct 2-word shingles, or its whole word sequence if it has fewer
words; a NULL or blank text has an empty set and links with nothing.  Rows
without ``doc_id`` are returned unlinked (NULL component, kept).  Repeated rows
are rows of one component; the smallest ``doc_id`` is the component's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.common import written
from paylens.llm.components import components, merged
from paylens.llm.hashing import GOLD, WordHash, distinct, grams, mixed

BANDS, ROWS = 40, 5
T = BANDS * ROWS
HUB_ORDERS = 6
MIN_AGREE = 0.6  # least share of equal coordinates of a pair worth comparing in full; 0.8 - 7 deviations
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles (see the module text)."""
    h = hashes.of((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    return distinct(grams(h, min(width, len(h)))) if len(h) else h


def sketch(elements: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch: ``t`` filled coordinates, each ``round << 48 | value``."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty, np.uint64)
    n, i, low = len(elements), 0, np.uint64((1 << 48) - 1)
    while i < t and (i == 0 or (out == empty).any()):
        # as many rounds at once as usually fill the rest; later rounds never displace earlier ones
        r = min(t - i, max(1, int(t * 6 / n) if i == 0 else 2048 // n))
        rounds = np.arange(i, i + r, dtype=np.uint64)[:, None]
        h = mixed(elements[None, :] + mixed((rounds + np.uint64(1)) * GOLD))
        where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, where.ravel().astype(np.int64), ((rounds << np.uint64(48)) | (h & low)).ravel())
        i += r
    for j in np.flatnonzero(out == empty):
        seed = mixed(np.array([t + j + 1], np.uint64) * GOLD)
        out[j] = (np.uint64(t + j) << np.uint64(48)) | (mixed(elements + seed) & low).min()
    return out


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    c = coords.reshape(bands, rows)
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64) * GOLD)
    for j in range(rows):
        out = mixed(out * GOLD + c[:, j])
    return out.view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n, k1, k2, bands)`` per row of ``(doc_id, text)``; ``k1, k2`` digest the shingle set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text, width, hashes)
                if not len(s):
                    out.append((doc_id, 0, 0, 0, None))
                    continue
                c = sketch(s, bands * rows)
                out.append((doc_id, len(s), *_set_key(s), band_keys(c, bands, rows)))
            f = pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "bands"])
            f["doc_id"] = f["doc_id"].astype("Int64")
            yield f

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int, coords: int) -> DataFrame:
    """``(node, shingles, coords)`` of ``(doc_id, text)`` rows.

    ``shingles`` are the distinct hashes; ``coords`` holds 16 bits of each sketch coordinate.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            out = [(i, s.view(np.int64), mixed(sketch(s, coords)).astype(np.uint16).tobytes())
                   for i, t in zip(b["doc_id"], b["text"]) if len(s := shingle_set(t, width, hashes))]
            yield pd.DataFrame(out, columns=["node", "shingles", "coords"])

    return docs.select("doc_id", "text").mapInPandas(run, "node long, shingles array<long>, coords binary")


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))
                      for x, y in zip(a, b)], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, coords: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity.

    Sketches are compared first; only pairs that could pass join the full sets.
    """
    agree = F.pandas_udf(_agreement, "long")
    marks = sets.select("node", "coords")
    near = (pairs.join(marks.withColumnsRenamed({"node": "a", "coords": "_x"}), "a")
            .join(marks.withColumnsRenamed({"node": "b", "coords": "_y"}), "b")
            .where(agree("_x", "_y") >= MIN_AGREE * coords).select("a", "b").distinct())
    full = sets.select("node", "shingles")
    both = F.size(F.array_intersect("_x", "_y"))
    return (near.join(full.withColumnsRenamed({"node": "a", "shingles": "_x"}), "a")
            .join(full.withColumnsRenamed({"node": "b", "shingles": "_y"}), "b")
            .where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b").distinct())


def differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(hub, node, row, n, c, d, a)``: what the sets of a group differ in from its bulk.

    ``groups`` has ``(hub, node)``: the nodes that share a bucket with a hub.  Let c be
    the shingles that more than half of a group's sets hold (none, in a group that is
    not much alike) and ``d``, D(x), those that x and c do not share.  Two sets of summed
    size S reach the similarity if and only if they differ in at most
    S (100 - percent) / (100 + percent) shingles, so with
    A(x) = |D(x)| (100 + percent) - |x| (100 - percent), the column ``a``,
    if and only if 2 (100 + percent) |D(x) and D(y)| >= A(x) + A(y).
    """
    rows = sets.select("node", "shingles", F.xxhash64("shingles").alias("row"), F.size("shingles").alias("n"))
    rows = written(groups.join(rows, "node"), "open-sets", release=True)
    size = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    held = rows.select("hub", F.explode("shingles").alias("s")).groupBy("hub", "s").agg(F.count(F.lit(1)).alias("f"))
    common = held.join(size, "hub").where("2 * f > size").groupBy("hub").agg(F.collect_set("s").alias("c"))
    c = F.coalesce("c", F.array().cast("array<bigint>"))
    d = F.concat(F.array_except("shingles", c), F.array_except(c, "shingles"))
    own = rows.join(common, "hub", "left").select("hub", "node", "row", "n", F.size(c).alias("c"), d.alias("d"))
    return written(own.withColumn("a", F.size("d") * (100 + percent) - F.col("n") * (100 - percent)), "open-differences")


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def central_pairs(own: DataFrame) -> DataFrame:
    """Pairs of a set with the group's set of smallest A, its centre, that are alike for certain.

    If A(x) + A(y) <= 0 for any two sets of a group, both stand in such a pair.
    """
    centre = own.groupBy("hub").agg(F.min(F.struct("a", "node")).alias("m"))
    return own.join(centre, "hub").where("a + m.a <= 0 and node <> m.node").select(*_pair("node", "m.node")).distinct()


def rare_pairs(own: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different components that may reach the similarity.

    Exact bounds, none by sampling.  Two sets with A(x) + A(y) > 0 that reach the
    similarity share an element of D.  With the elements in one order for the group,
    rarest first, the first that they share stands so early in either that enough are
    left; elements behind that place are not joined at all.  Copies of one text that
    differ by edits of their own hold little in D that others hold, so they meet few
    others, however many they are.  Groups in one component are left out, and of pairs
    one is outside the hub's component.
    """
    p, q = 100 + percent, 100 - percent
    root = comp.select(F.col("node").alias("hub"), F.col("root").alias("hub_comp"))
    own = own.join(comp.withColumnRenamed("root", "comp"), "node", "left").join(root, "hub", "left").withColumns({
        "comp": F.coalesce("comp", "node"), "hub_comp": F.coalesce("hub_comp", "hub")})
    group = own.groupBy("hub").agg(F.min("a").alias("least"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    own = own.join(group.where("x < y").select("hub", "least"), "hub").withColumn("stray", F.expr("comp <> hub_comp"))

    # the least A that a partner can have: that of the group's centre, and what its size alone asks for
    best = F.least(F.greatest(F.col("c").cast("double"), F.col("n") * percent / 100), F.col("n") * 100 / percent)
    least = F.greatest(F.col("least").cast("double"), F.abs(best - F.col("c")) * p - best * q)
    need = F.greatest(F.lit(1), F.ceil((F.col("a") + least) / (2 * p) - 1e-6).cast("int"))
    open_ = own.select("hub", "node", "row", "comp", "stray", "a", F.size("d").alias("n"), need.alias("need"), F.explode("d").alias("s"))
    often = open_.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(W.partitionBy("hub", "node", "row").orderBy("times", "s"))
    early = open_.join(often, ["hub", "s"]).withColumn("i", rank).where("i <= n - need + 1 and times > 1")
    early = written(early.select("hub", "s", "node", "comp", "stray", "n", "a", "i"), "early-shingles")
    stray = early.where("stray").select("hub", "s", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "n", "a", "i")])
    left = 1 + F.least(F.col("n") - F.col("i"), F.col("x_n") - F.col("x_i"))
    return stray.join(early, ["hub", "s"]).where("comp <> x_comp and (not stray or x_node < node)").where(
        2 * p * left >= F.col("a") + F.col("x_a")).select(*_pair("node", "x_node")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs`` (``doc_id``, ``text``).

    Links documents whose distinct ``width``-word shingles have
    ``100 * |intersection| >= percent * |union|``; see the module text.
    """
    docs = docs.select("doc_id", "text")
    sk = written(sketches(docs, width, bands, rows), "sketches")
    known = sk.where("n > 0 and doc_id is not null")
    node_of = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    reps = written(known.join(node_of, ["k1", "k2"]).where("doc_id = node").select("node", "n", "bands"), "nodes")

    placed = reps.select("node", "n", F.explode("bands").alias("band"))
    # one of HUB_ORDERS pseudorandom orders of the nodes picks the hub: a group meets few different hubs
    order = F.xxhash64(F.pmod("band", F.lit(HUB_ORDERS)), "node")
    hub = F.min(F.struct(order.alias("h"), "node", "n"))
    buckets = placed.groupBy("band").agg(hub.alias("hub"), F.max("node").alias("most"), F.min("node").alias("least"))
    buckets = buckets.where("least < most").select("band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = written(placed.join(buckets, "band"), "members", release=True)

    needed = members.select(F.col("node").alias("doc_id")).distinct()
    sets = written(shingle_sets(docs.join(needed, "doc_id"), width, bands * rows), "sets", release=True)
    size_ok = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    tried = members.where("node <> hub").where(size_ok(F.col("n"), F.col("hub_n"))).select(
        F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    # rows that share a doc_id are one document, whatever their texts
    ids = known.join(node_of, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    repeated = ids.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(ids, "a").select("a", "b")
    links = written(confirmed(tried, sets, percent, bands * rows).unionByName(repeated), "links", release=True)
    comp = components(links)

    # buckets that still hold several components: nodes outside the hub's against all others
    m = members.join(comp, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    m = written(m, "members")
    open_ = m.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    m = m.join(open_.where("least < most").select("band"), "band").select("hub", "node").distinct()
    own = differences(written(m, "open-nodes"), sets, percent)
    near = confirmed(written(central_pairs(own), "central-pairs"), sets, percent, bands * rows)
    comp = written(merged(comp, written(near, "links")), "components")
    more = confirmed(written(rare_pairs(own, comp, percent), "pairs"), sets, percent, bands * rows)
    comp = merged(comp, written(more, "links"))

    out = known.join(node_of, ["k1", "k2"]).join(comp, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    alone = sk.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dup(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes over 2-word shingles at similarity 0.8."""
    return near_duplicates(docs, width=2, percent=80)
