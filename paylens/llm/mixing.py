"""Mixing sources to target weights (operator 3), in DataFrame operations only.

The words of each source form one stream, cut into blocks of ``block_len``
words.  Output shards have ``shard_blocks`` slots each (the last one the rest).  The
source counts of a shard are multinomial draws with the sources' shares, corrected to
the targets and the bound on repeats by conditioning: all shards' counts are drawn
together, given that they add up to the draws that each source has.  Multinomial counts
under that condition are those of a random order of all draws cut into shards, so
:func:`draws` maps a draw's number through a pseudorandom permutation of all draws, which
gives its shard and slot at once (:func:`shard_counts` is the table of counts).
Draw ``k`` of a source stands for the block whose index a per-source, per-epoch
pseudorandom permutation maps to slot ``k``; blocks and draws are joined on
``(source, block index)``.

*Stream positions.*  A document's place in its source's stream is a prefix sum.
Documents are dealt to ``CHUNKS`` chunks per source by a hash, summed inside a
chunk by a window, and chunks are summed over at most ``CHUNKS`` rows per
source, so no task holds a source: a hot source is spread over all chunks.

*Permutation.*  Swap-or-not: in each round ``x`` may change places with
``key - x (mod n)``, by one hash bit of the larger of the two.  Each round is
its own inverse, so the whole is a bijection of ``[0, n)`` for any ``n``.

Results: a NULL or blank text has size 0 and takes part in no block; a NULL
source is a source of its own, last in the order; documents may share or lack
a ``doc_id`` (every row keeps its own place).  An empty table gives no rows.
Everything is a function of the rows alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.common import word_array, written

CHUNKS = 4096       # chunks per source for the prefix sums
BLOCK_LEN = 128     # words per block
SHARD_BLOCKS = 1024  # blocks per output shard
WEIGHTS = (1, 2, 3)  # by source in code-point order, repeating
MAX_REPEATS = 3     # a source's target is at most this many times its size
ROUNDS = 16
SEED = 20240131


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                   block_len: int = BLOCK_LEN) -> DataFrame:
    """Targets per source from ``(src, source_size)``: one row per source in and out.

    All sizes together are shared by weight; a target stops at ``max_repeats``
    times the source's size and the rest is shared again by weight.  The fixed
    point is ``min(cap, weight * level)``: sources in order of ``cap / weight``
    are capped until the level that the others can hold is reached.
    """
    order = W.orderBy("src")
    t = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                             ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), "src")
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding,
                                                                               W.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    t = t.withColumn("_level", level).withColumn("_at", F.row_number().over(by_ratio))
    t = t.withColumn("_capped", F.col("_cap") / F.col("_w") < F.col("_level"))
    t = t.withColumn("_rest", F.min(F.when(~F.col("_capped"), F.struct("_at", "_level"))).over(every)["_level"])
    t = t.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_w") * F.col("_rest"))))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block_len).cast("long"))
    t = t.withColumn("n_draws", F.when(F.col("source_size") > 0, F.least(
        F.col("n_blocks") * max_repeats,
        F.rint(F.col("n_blocks") * F.col("target") / F.col("source_size")).cast("long"))).otherwise(F.lit(0)))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("first_draw", F.coalesce(F.sum("n_draws").over(earlier), F.lit(0)))
    t = t.withColumn("all_draws", F.sum("n_draws").over(every))
    return t.select("src", "source_size", "target", "n_blocks", "n_draws", "first_draw", "all_draws")


def packed(docs: DataFrame, block_len: int = BLOCK_LEN, weights: Sequence[float] = WEIGHTS,
           max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(doc_id, source, text)`` rows with their place in the source's word stream.

    Adds ``src`` (source key, orders NULL last), ``size``, ``row`` (with ``src``
    and ``chunk`` the identity of a row), ``start`` (word offset in the stream)
    and the source's columns of :func:`source_targets`.
    """
    d = docs.select("doc_id", "source", "text")
    d = d.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")))
    d = d.withColumn("hash", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod("hash", F.lit(CHUNKS)))
    d = d.withColumn("size", F.size(word_array(F.col("text"))).cast("long"))
    sums = written(d.groupBy("src", "chunk").agg(F.sum("size").alias("chunk_size")), "mix-chunks")
    sources = source_targets(sums.groupBy("src").agg(F.sum("chunk_size").alias("source_size")),
                             weights, max_repeats, block_len)
    before = W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (sums.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)))
               .drop("chunk_size").join(sources, "src"))
    here = W.partitionBy("src", "chunk").orderBy("hash", "doc_id")
    d = d.withColumn("row", F.row_number().over(here)).withColumn(
        "_before", F.coalesce(F.sum("size").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(offsets, ["src", "chunk"])
    return d.withColumn("start", F.col("chunk_start") + F.col("_before")).drop("_before", "chunk_start", "hash")


def pieces(p: DataFrame, block_len: int = BLOCK_LEN, with_words: bool = False) -> DataFrame:
    """One row per row of ``p`` and block it touches: ``block``, ``n`` words, ``at`` (offset in the block).

    A row without words has one row with NULL ``block``.  ``with_words`` adds the piece's words, joined
    by one space (as one string they take a third of an array's room in a shuffle), and leaves rows without words out.
    """
    first = F.floor(F.col("start") / block_len)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_len)
    span = F.when(F.col("size") > 0, F.sequence(first, last))
    lo = lambda b: F.greatest(F.col("start"), b * block_len)
    hi = lambda b: F.least(F.col("start") + F.col("size"), (b + 1) * block_len)
    if not with_words:
        x = p.drop("text").withColumn("block", F.explode_outer(span))
        return x.withColumn("n", hi(F.col("block")) - lo(F.col("block"))).withColumn(
            "at", lo(F.col("block")) - F.col("block") * block_len)
    x = p.withColumn("_words", word_array(F.col("text")))
    cut = F.transform(span, lambda b: F.struct(
        b.alias("block"), (hi(b) - lo(b)).alias("n"), (lo(b) - b * block_len).alias("at"),
        F.array_join(F.slice("_words", (lo(b) - F.col("start") + 1).cast("int"), (hi(b) - lo(b)).cast("int")),
                     " ").alias("words")))
    return x.select(*[c for c in p.columns if c != "text"], F.explode(cut).alias("_p")).select("*", "_p.*").drop("_p")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom bijection of ``[0, n)`` chosen by ``key``."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def epoch_slot(seed: int, epoch: Column | None = None) -> Column:
    """The permuted index of a block among its source's blocks in an epoch (0 if not given)."""
    return permuted(F.col("block"), F.col("n_blocks"), F.lit(seed), F.col("src"), F.lit(0) if epoch is None else epoch)


def draws(parts: DataFrame, max_repeats: int = MAX_REPEATS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The draws of every block: ``(src, block, k, shard, slot)``.

    A block is listed by the one piece that holds its first word; in each epoch
    its slot in the source is its permuted index, and it is drawn if the source still
    has a draw for that slot.  The draws of all sources, numbered one after the other,
    are permuted once more and cut into shards.
    """
    b = parts.where("at = 0 and n > 0").select("src", "block", "n_blocks", "n_draws", "first_draw", "all_draws")
    b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    b = b.where(F.col("epoch") * F.col("n_blocks") < F.col("n_draws"))
    b = b.withColumn("k", F.col("epoch") * F.col("n_blocks") + epoch_slot(seed, F.col("epoch")))
    b = b.where("k < n_draws").withColumn(
        "_place", permuted(F.col("first_draw") + F.col("k"), F.col("all_draws"), F.lit(seed), F.lit("shards")))
    return b.select("src", "block", "k", F.floor(F.col("_place") / shard_blocks).alias("shard"),
                    (F.col("_place") % shard_blocks + 1).alias("slot"))


def shard_counts(drawn: DataFrame) -> DataFrame:
    """Source counts per output shard, ``(shard, src, n_blocks)``."""
    return drawn.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("n_blocks"))


def mix(docs: DataFrame, block_len: int = BLOCK_LEN, weights: Sequence[float] = WEIGHTS,
        max_repeats: int = MAX_REPEATS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: one row per drawn block.

    Columns: ``shard``, ``slot`` (place in the shard, from 1), ``source``,
    ``block``, ``n_words``, ``doc_ids`` (in stream order) and ``text``.  A block
    holds at most ``block_len`` words, so grouping its pieces is bounded.
    """
    p = packed(docs, block_len, weights, max_repeats)
    # A source with fewer draws than blocks leaves blocks out; their words need not move.
    drawn_once = (F.col("n_draws") >= F.col("n_blocks")) | (epoch_slot(seed) < F.col("n_draws"))
    parts = pieces(p, block_len, with_words=True).where(drawn_once)
    blocks = parts.groupBy("src", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "doc_id", "words"))).alias("_p"), F.sum("n").alias("n_words"))
    drawn = draws(pieces(p, block_len), max_repeats, shard_blocks, seed)
    return drawn.join(blocks, ["src", "block"]).select(
        "shard", "slot", F.when(F.col("src") != "t", F.substring("src", 2, 1 << 30)).alias("source"), "block",
        "n_words", F.col("_p.doc_id").alias("doc_ids"),
        F.array_join("_p.words", " ").alias("text"))


def op3_mix_sources(docs: DataFrame) -> DataFrame:
    """Words that the mix takes from each document."""
    p = packed(docs)
    parts = pieces(p)
    times = draws(parts).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    row = ["src", "chunk", "row", "doc_id", "size", "source_size", "target"]
    return (parts.join(times, ["src", "block"], "left").groupBy(*row)
            .agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))
