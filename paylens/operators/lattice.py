"""Root causes at every level of the segment lattice.

:func:`paylens.operators.rootcause.root_cause_rank` ranks the finest groups only, so an
incident of a whole platform comes out as many small causes.  Here every combination of
dimensions is a candidate, from one value of one dimension to all of them.

A candidate's failures are compared with what its own attempts would fail by the
previous day's rate (drawn towards the overall rate by ``PRIOR`` attempts, so that a
segment without a past has an expectation).  Its score is ``excess^2 / (expected + 1)``.
For a segment that is evenly affected the score adds up over its parts, so the coarser
segment wins; with healthy parts mixed in it falls, so a finer one wins.  Of segments
with equal scores (the same rows) the one with fewer fixed dimensions is taken.

Causes are chosen one after the other and do not overlap: the rows of a chosen segment
are removed before the next round.  Every round works on the leaf table, one row per
combination of values that occurs, aggregated once from the payments; the cube over it
is an aggregation by ``2^dimensions`` grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.config import DIMS
from paylens.functions.expr import is_fail, round_half_up

PRIOR = 10  # attempts that the overall rate counts for in a segment's own past
ANY = "*"   # a dimension that a cause leaves open, in its label
COUNTS = ("now_attempts", "now_fails", "prev_attempts", "prev_fails")


def leaf_counts(tagged_payments: DataFrame, dims: Sequence[str] = DIMS, extra: Sequence[str] = ()) -> DataFrame:
    """Attempts and failures of both windows per leaf segment; ``tag`` is ``now`` or ``prev``."""
    now = F.col("tag") == "now"
    return tagged_payments.groupBy(*dims, *extra).agg(
        F.count_if(now).alias("now_attempts"), F.count_if(now & is_fail()).alias("now_fails"),
        F.count_if(~now).alias("prev_attempts"), F.count_if(~now & is_fail()).alias("prev_fails"))


def scored_segments(leaves: DataFrame, past: Column, dims: Sequence[str] = DIMS) -> DataFrame:
    """``(fixed, dims..., counts, expected, excess, score)`` of every segment of the lattice but the whole.

    ``fixed`` has a bit per dimension that the segment fixes (the first one highest), so an
    open dimension is told apart from a NULL value.  ``past`` is the overall failure rate of
    the previous window.
    """
    bits = sum(((1 - F.grouping(d).cast("int")) * 2**k for k, d in enumerate(reversed(dims))), F.lit(0))
    g = leaves.cube(*dims).agg(*[F.sum(c).alias(c) for c in COUNTS], bits.cast("int").alias("fixed"))
    g = g.where("fixed > 0")
    rate = (F.col("prev_fails").cast("double") + past * F.lit(float(PRIOR))) / (F.col("prev_attempts") + F.lit(PRIOR)).cast("double")
    expected = F.col("now_attempts").cast("double") * rate
    g = g.withColumn("_e", expected).withColumn("_x", F.col("now_fails").cast("double") - F.col("_e"))
    score = F.when(F.col("_x") > 0, F.col("_x") * F.col("_x") / (F.col("_e") + F.lit(1.0))).otherwise(F.lit(0.0))
    return g.select("fixed", *dims, *COUNTS, round_half_up("_e", 2).alias("expected"), round_half_up("_x", 2).alias("excess"),
                    round_half_up(score, 4).alias("score"))


def _rate(fails: Column, attempts: Column) -> Column:
    return F.when(attempts > 0, fails.cast("double") / attempts.cast("double")).otherwise(F.lit(0.0))


def _segments_of(leaves: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``leaves`` once per segment that holds them: ``s_fixed`` and ``s_<dim>`` (NULL where open) beside their columns."""
    n = len(dims)
    masks = F.explode(F.array(*[F.lit(m) for m in range(1, 2**n)]))
    fixes = lambda k: F.col("s_fixed").bitwiseAND(F.lit(2 ** (n - 1 - k))) != 0
    return leaves.withColumn("s_fixed", masks).select(
        "*", *[F.when(fixes(k), F.col(d)).alias("s_" + d) for k, d in enumerate(dims)])


def _in_causes(leaves: DataFrame, causes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The rows of ``leaves`` that lie in a cause, with its number ``cause``: an equality join on the segment."""
    named = causes.select("cause", F.col("fixed").alias("c_fixed"), *[F.col(d).alias("c_" + d) for d in dims])
    cond = F.col("s_fixed") == F.col("c_fixed")
    for d in dims:
        cond = cond & F.col("s_" + d).eqNullSafe(F.col("c_" + d))
    return _segments_of(leaves, dims).join(named, cond).select("cause", *leaves.columns)


def lattice_causes(leaves: DataFrame, codes: DataFrame, k: int = 3, dims: Sequence[str] = DIMS) -> DataFrame:
    """Up to ``k`` disjoint causes, best first.

    ``codes`` has the failures of the present window per leaf and error code
    (``error_code``, ``now_fails``); a cause names the code with most failures in it.
    ``excess_share`` is the cause's part of the whole window's excess.
    """
    # one value each, read as scalar subqueries
    past = leaves.agg(_rate(F.sum("prev_fails"), F.sum("prev_attempts")).alias("past")).scalar()
    expected = F.sum("now_attempts").cast("double") * F.sum("prev_fails").cast("double") / F.sum("prev_attempts").cast("double")
    total = leaves.agg((F.sum("now_fails").cast("double") - F.when(F.sum("prev_attempts") > 0, expected).otherwise(F.lit(0.0)))
                       .alias("total")).scalar()
    rest, chosen = leaves, None
    order = [F.col("score").desc(), F.bit_count("fixed"), *[F.col(d).asc_nulls_first() for d in dims], F.col("fixed")]
    for rank in range(1, k + 1):
        best = scored_segments(rest, past, dims).where("score > 0").orderBy(*order).limit(1).withColumn("cause", F.lit(rank))
        chosen = best if chosen is None else chosen.unionByName(best)
        if rank < k:
            taken = _in_causes(rest, best, dims).select(*[F.col(d).alias("t_" + d) for d in dims])
            cond = F.lit(True)
            for d in dims:
                cond = cond & F.col(d).eqNullSafe(F.col("t_" + d))
            rest = rest.join(taken, cond, "left_anti")
    inside = _in_causes(codes.where("now_fails > 0"), chosen, dims)
    # causes do not overlap, so a leaf is counted in one of them
    by_code = inside.groupBy("cause", "error_code").agg(F.sum("now_fails").alias("c"))
    top = by_code.groupBy("cause").agg(F.min(F.struct((-F.col("c")).alias("m"), "error_code")).alias("t"))
    out = chosen.join(top, "cause", "left").withColumn("_total", total)
    bit = {d: 2**i for i, d in enumerate(reversed(dims))}
    part = lambda d: F.when(F.col("fixed").bitwiseAND(F.lit(bit[d])) == 0, ANY).otherwise(F.coalesce(d, F.lit("")))
    share = F.when(F.col("_total") > 0, round_half_up(F.col("excess") / F.col("_total"), 4))
    return out.select(
        "cause", F.bit_count("fixed").cast("int").alias("level"), "fixed", *dims, F.col("t.error_code").alias("error_code"), *COUNTS,
        "expected", "excess", "score", share.alias("excess_share"),
        F.concat_ws(" + ", *[part(d) for d in dims]).alias("segment"))
