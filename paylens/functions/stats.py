"""Exact mean / sample standard deviation from integer moments.

Rates are rounded to four decimals and money to cents before any baseline is
taken, so every sample is an integer number of *units* (basis points or
cents).  Carrying ``n``, ``Σx`` and ``Σx²`` as exact integers makes the
statistics independent of summation order — the same bits on every executor
layout, after any retry, and in any other engine that evaluates the same
formula — and lets a leave-one-out baseline subtract the own row without
cancellation error.

``Σx²`` is kept as DECIMAL(38,0): a 5-minute revenue bucket of 10¹⁰ cents
squared already exceeds BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"


def basis_points(rate: Column | str) -> Column:
    """A rate rounded to four decimals as an exact integer (1.0 → 10000);
    the value is on the 1e-4 grid, so ``rint`` returns it exactly."""
    c = F.col(rate) if isinstance(rate, str) else rate
    return F.rint(c * F.lit(10000)).cast("bigint")


def to_units(c: Column, scale: int) -> Column:
    """Value with ``log10(scale)`` decimals as exact integer units."""
    return F.rint(c * F.lit(scale)).cast("bigint")


def exact_mean(n: Column, sx: Column, scale: int) -> Column:
    """Mean of ``n`` samples with unit sum ``sx``; NULL when ``n`` = 0."""
    return F.when(
        n > 0, sx.cast("double") / n.cast("double") / F.lit(float(scale))
    )


def exact_stddev(n: Column, sx: Column, sq: Column, scale: int) -> Column:
    """Sample standard deviation; NULL when ``n`` < 2 (as SQL ``STDDEV``).

    ``n·Σx² − (Σx)²`` is an exact non-negative integer, so a constant series
    gives exactly 0 — the ``std > 0`` guard of the anomaly rule never sees a
    rounding artefact.
    """
    n_d = n.cast(EXACT)
    num = n_d * sq.cast(EXACT) - sx.cast(EXACT) * sx.cast(EXACT)
    var = num.cast("double") / (n.cast("double") * (n - 1).cast("double"))
    return F.when(n > 1, F.sqrt(var) / F.lit(float(scale)))
