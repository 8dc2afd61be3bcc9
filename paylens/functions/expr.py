"""Scalar column expressions.

Everything here returns a ``pyspark.sql.Column`` built from Spark built-ins, so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative nudge before rounding so that a value whose decimal text is an exact
# tie rounds half-up in every engine, whatever last-bit noise the arithmetic
# left (Spark rounds the decimal text half-up; other engines round the scaled
# binary value).  Being relative it holds at any magnitude: it is far above the
# last bit and far below a unit of the digits kept.
_TIE_NUDGE = 1e-13
# Money is summed in integer millionths and rounded to cents once, at the end.
MICROS = 1_000_000
_MICROS_PER_CENT = MICROS // 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int) -> Column:
    """``ROUND(x, digits)`` with ties broken half-up away from zero, engine-stable."""
    x = _col(c)
    return F.round(x * F.lit(1.0 + _TIE_NUDGE), digits)


def cents(c: Column | str) -> Column:
    """An amount already rounded to two decimals as exact integer cents.

    ``amount × 100`` of a two-decimal amount lies within 1e-9 of an integer,
    so ``rint`` (a plain double op, ~3× cheaper per row than ``round``, which
    goes through BigDecimal) returns exactly that integer.
    """
    return F.rint(_col(c) * F.lit(100)).cast("bigint")


def micros(c: Column | str) -> Column:
    """Any money amount as integer millionths: sums are exact and independent of order."""
    return F.rint(_col(c) * F.lit(MICROS)).cast("bigint")


def rounded_micros(c: Column | str) -> Column:
    """Integer millionths as an amount in currency, rounded half-up to cents (integer arithmetic)."""
    x = _col(c)
    half = F.when(x < 0, -(_MICROS_PER_CENT // 2)).otherwise(_MICROS_PER_CENT // 2)
    up = x + half
    return from_cents(((up - up % _MICROS_PER_CENT) / F.lit(_MICROS_PER_CENT)).cast("bigint"))


def from_cents(c: Column | str) -> Column:
    """Integer cents back to a double amount (one correctly rounded division)."""
    return _col(c).cast("double") / F.lit(100.0)


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double; NULL when ``den`` is 0 (ANSI-safe)."""
    n, d = _col(num), _col(den)
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def ntz(value: str | _dt.datetime | _dt.date) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


def bucket_start(ts: Column | str, minutes: int) -> Column:
    """Floor of ``ts`` to a ``minutes``-wide bucket.

    Uses the tumbling-window start — plain long arithmetic on the NTZ value,
    no session time zone, the cheapest floor per row.  ``window`` on its own
    would drop rows whose timestamp is NULL (Spark adds an ``isnotnull``
    filter); feeding it ``coalesce(ts, epoch)`` keeps every row, and a NULL
    timestamp is mapped back to a NULL bucket — its own group, as in SQL.
    """
    t = _col(ts)
    start = F.window(F.coalesce(t, ntz("1970-01-01 00:00:00")), f"{int(minutes)} minutes").start
    return F.when(t.isNotNull(), start)


def tod_slot(bucket: Column | str, minutes: int) -> Column:
    """Time-of-day slot of a bucket start: 0 .. 1440/minutes - 1."""
    b = _col(bucket)
    return F.floor((F.hour(b) * 60 + F.minute(b)) / F.lit(int(minutes))).cast("int")


def is_success(status: Column | str = "payment_status") -> Column:
    return _col(status) == F.lit("success")


def is_fail(status: Column | str = "payment_status") -> Column:
    return _col(status) == F.lit("fail")


def segment_condition(segment: Mapping[str, str]) -> Column:
    """Conjunction ``dim1 = v1 AND dim2 = v2 ...`` (SQL three-valued logic)."""
    cond = F.lit(True)
    for dim, value in segment.items():
        cond = cond & (F.col(dim) == F.lit(value))
    return cond
