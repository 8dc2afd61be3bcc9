"""Restricting events to time windows without collecting the bounds.

The reference collects the anomaly window to the driver and splices it into
SQL text.  Here a window is a row of a small DataFrame (one per metric, per
incident, or per shifted copy), and restriction is a join:

    events.dt == windows.dt AND hour(events.ts) == windows.hour
        (windows exploded to the days and hours they touch)
    AND events.ts BETWEEN window_start AND window_end

The equalities make it a *hash* join instead of a nested loop.  The day — when
the events come from a table partitioned by ``dt`` — lets Spark's dynamic
partition pruning restrict the scan; the hour keeps an event from meeting the
other windows of its day and spreads a hot day over 24 keys.  The windows of the
day's own anomaly (≤ 2 rows × a day) are broadcast.

A window table that a caller supplies may hold many windows of any length, from
seconds to years.  It is joined by *dyadic* cells (:func:`dyadic_cover`): time is cut
into cells of ``2^k`` grains at every level k, and a window is the disjoint union of
at most two cells per level, so a month of minutes is about 20 rows instead of 43,200.
An event lies in one cell of each level and probes only the levels that the windows
use (a set of at most ``LEVELS`` numbers).  The join is an equality on (level, cell) that
the planner sizes and AQE splits where a cell is hot.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions.expr import bucket_start, ntz

WIN_START = "window_start"
WIN_END = "window_end"
_DAY = "_win_dt"
_HOUR = "_win_hour"


def window_table(bounds: DataFrame, start: str = "astart", end: str = "aend",
                 shift_days: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Normalise a bounds DataFrame to ``(*keep, window_start, window_end)``.

    Rows with a NULL bound (no anomaly) are dropped, so every consumer of an
    empty window returns an empty result instead of failing.
    """
    s, e = F.col(start), F.col(end)
    if shift_days:
        delta = F.make_dt_interval(F.lit(abs(shift_days)))
        s, e = (s - delta, e - delta) if shift_days > 0 else (s + delta, e + delta)
    return bounds.select(*keep, s.alias(WIN_START), e.alias(WIN_END)).where(
        F.col(WIN_START).isNotNull() & F.col(WIN_END).isNotNull()
    )


def restrict_to_windows(df: DataFrame, windows: DataFrame, ts_col: str = "event_ts",
                        keep: Sequence[str] = (),
                        day_range: tuple[_dt.date, _dt.date] | None = None,
                        bounded: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``ts_col`` lies in a window (closed interval).

    A row inside several windows is returned once per window (``keep`` tells
    them apart).  ``day_range=(first_day, last_day)`` is an optional promise
    that every window lies within those days; it adds a literal range filter
    that the parquet scan can use for row-group skipping even on tables that
    are not partitioned by day.

    ``bounded=True``: windows derived from the day's anomaly, ≤ 2 rows × a day,
    broadcast.  For a caller-supplied window table pass ``bounded=False``: the join
    goes by dyadic cells, without a hint.
    """
    if not bounded:
        return _restrict_by_cells(df, windows, ts_col, keep, day_range)
    wd = windows.select(*keep, WIN_START, WIN_END).withColumn("_first", bucket_start(WIN_START, 60))
    wd = wd.withColumn(_HOUR, F.explode(F.sequence("_first", WIN_END, F.expr("INTERVAL 1 HOUR")))).drop("_first")
    wd = wd.withColumn(_DAY, F.to_date(_HOUR))
    df = _within_days(df, ts_col, day_range)
    day: Column = F.col("dt") if "dt" in df.columns else F.to_date(ts_col)
    df = df.withColumn("_ts_hour", bucket_start(ts_col, 60))
    joined = df.join(F.broadcast(wd), (day == wd[_DAY]) & (F.col("_ts_hour") == wd[_HOUR]))
    return joined.where(F.col(ts_col).between(F.col(WIN_START), F.col(WIN_END))).drop(_DAY, _HOUR, "_ts_hour")


def _within_days(df: DataFrame, ts_col: str, day_range: tuple[_dt.date, _dt.date] | None) -> DataFrame:
    if day_range is None:
        return df
    lo, hi = day_range
    df = df.where((F.col(ts_col) >= ntz(lo)) & (F.col(ts_col) < ntz(hi + _dt.timedelta(days=1))))
    if "dt" in df.columns:  # day-partitioned table: static partition pruning
        df = df.where(F.col("dt").between(F.lit(lo), F.lit(hi)))
    return df


# -- dyadic cells -------------------------------------------------------------------

GRAIN_SECONDS = 60  # narrowest cell; windows within one grain meet its events and are told apart by their bounds
LEVELS = 32         # cells of 2^31 minutes, about 4,000 years
_LEVEL = "_cell_level"
_CELL = "_cell"


def _grain(ts: Column) -> Column:
    """Number of the narrowest cell that a wall-clock time lies in."""
    return F.floor(F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), ts) / F.lit(GRAIN_SECONDS)).cast("bigint")


def dyadic_cover(windows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, window_start, window_end, _cell_level, _cell)``: disjoint cells whose union covers a window's grains.

    Seen from level k, the grains ``[a, b]`` still uncovered by lower levels are the cells
    from ``ceil(a / 2^k)`` to ``floor((b + 1) / 2^k)``, exclusive; an odd first cell and an odd
    end have no sibling in the window and are emitted, the rest is left to level k + 1.
    Windows that end before they start have no cells.
    """
    a, b = _grain(F.col(WIN_START)), _grain(F.col(WIN_END))
    shift = lambda x, k: F.call_function("shiftright", x, k)

    def at_level(k: Column) -> Column:
        lo, hi = -shift(-F.col("_a"), k), shift(F.col("_b") + 1, k)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        return F.array_compact(F.array(
            F.when((lo < hi) & odd(lo), F.struct(k.alias(_LEVEL), lo.alias(_CELL))),
            F.when((lo < hi) & odd(hi), F.struct(k.alias(_LEVEL), (hi - 1).alias(_CELL)))))

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at_level)
    rows = windows.select(*keep, WIN_START, WIN_END, a.alias("_a"), b.alias("_b")).where(F.col(WIN_START) <= F.col(WIN_END))
    return rows.select(*keep, WIN_START, WIN_END, F.inline(F.flatten(levels)))


def _restrict_by_cells(df: DataFrame, windows: DataFrame, ts_col: str, keep: Sequence[str],
                       day_range: tuple[_dt.date, _dt.date] | None) -> DataFrame:
    cover = dyadic_cover(windows, keep)
    used = cover.agg(F.sort_array(F.collect_set(_LEVEL))).scalar()  # at most LEVELS numbers
    grain = _grain(F.col(ts_col))
    probes = F.transform("_levels", lambda k: F.struct(k.alias(_LEVEL), F.call_function("shiftright", grain, k).alias(_CELL)))
    events = _within_days(df, ts_col, day_range).where(F.col(ts_col).isNotNull()).withColumn("_levels", used)
    events = events.select(*df.columns, F.inline(probes))
    joined = events.join(cover, [_LEVEL, _CELL])
    return joined.where(F.col(ts_col).between(F.col(WIN_START), F.col(WIN_END))).drop(_LEVEL, _CELL)
