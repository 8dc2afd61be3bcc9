"""Incremental anomaly table on maintained seasonal moments.

A bucket's baseline needs, of its time-of-day slot, only the moments n, sum x and
sum x^2 over all days.  They are kept as a table and updated by difference: new minus
old values of the buckets that changed.  As the sums are exact integers, the result
equals a rebuild bit for bit.

Only the hours of the day in which a bucket changed get new anomaly rows (every day of a
slot is compared with the changed one); files of other hours are neither read nor
written.  An hour holds 12 slots of 5 minutes: a file per slot would hold two rows a day.

Tables below one folder, all immutable files of numbered generations:

* ``by_day/gen=g/dt=d``    — the overall series of a day;
* ``by_hour/gen=g/part=h`` — the same rows by hour of the day, with the hour's other days;
* ``anomaly/gen=g/part=h`` — the anomaly rows of an hour;
* ``days/gen=g``, ``moments/gen=g`` — whole small tables of each generation: which
  generation holds a day, and a slot's hour (with the slot's moments).

``moments/gen=g`` is written last, and its commit makes the generation visible: a
reader joins the tables with the newest complete manifest (partition pruning reads the
listed files alone), sees the old generation or the new one and never a missing
table, and a failed refresh leaves files that no manifest names.  :meth:`vacuum`
removes generations that no manifest kept needs.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES
from paylens.functions.stats import EXACT
from paylens.operators.cube import BUCKET, overall_from_payments
from paylens.operators.seasonal import anomaly, finish_moments, moment_inputs
from paylens.plans.gold import _days_filter
from paylens.session import unique_shared_path

SUMS = ("n", "sx_bp", "sq_bp", "sx_ct", "sq_ct")
_SERIES = (f"{BUCKET} timestamp_ntz, actual_revenue double, actual_psr double, actual_attempts bigint, "
           "x_bp bigint, x_ct bigint, ")
_BY_DAY = _SERIES + "slot int, part int, gen int, dt date"
_BY_HOUR = _SERIES + "dt date, slot int, gen int, part int"
_ANOMALY = (f"{BUCKET} timestamp_ntz, metric string, actual double, baseline double, z_score double, "
            "is_anomaly boolean, impact_estimated double, gen int, part int")
_MOMENTS = f"slot int, part int, n bigint, sx_bp bigint, sq_bp {EXACT}, sx_ct bigint, sq_ct {EXACT}, at int, gen int"
_DAYS = "dt date, at int, gen int"
_VALUES = ("actual_revenue", "actual_psr", "actual_attempts")


class SeasonalGold:
    """The anomaly table at ``location`` (a folder of its own in the shared directory if not given)."""

    def __init__(self, spark: SparkSession, location: str | None = None, minutes: int = BUCKET_MINUTES):
        self.spark, self.minutes = spark, minutes
        self.location = location or unique_shared_path(spark, "seasonal-gold")

    # -- reading ----------------------------------------------------------------------
    def generations(self) -> list[int]:
        """Complete generations, oldest first (a listing of one small folder)."""
        return sorted(g for g, done in self._listed("moments").items() if done)

    def _listed(self, name: str) -> dict[int, bool]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        return {int(s.getPath().getName().split("=")[1]): fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
                for s in fs.listStatus(path) if s.getPath().getName().startswith("gen=")}

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.location}/{name}").parquet(f"{self.location}/{name}")

    def _manifest(self, name: str, schema: str, gen: int | None) -> DataFrame:
        if gen is None:
            return self.spark.createDataFrame([], schema).drop("gen")
        return self.spark.read.schema(schema).parquet(f"{self.location}/{name}/gen={gen}").drop("gen")

    def _newest(self) -> int | None:
        return max(self.generations(), default=None)

    def moments(self, gen: int | None = None) -> DataFrame:
        """``(slot, part, n, sums, at)``: the moments of a slot, its hour and the generation that holds the hour's rows."""
        return self._manifest("moments", _MOMENTS, self._newest() if gen is None else gen)

    def _current(self, name: str, schema: str, gen: int | None, manifest: DataFrame, key: str) -> DataFrame:
        if gen is None:
            return self.spark.createDataFrame([], schema).drop("gen")
        # at most one manifest row per hour or day; the filter lets the planner prune partitions by the join
        m = manifest.where(F.col("at") > 0).select(F.col(key).alias("_key"), "at").distinct()
        t = self._table(name, schema)
        return t.join(m, (t[key] == m["_key"]) & (t["gen"] == m["at"])).drop("_key", "at", "gen")

    def anomaly(self, gen: int | None = None) -> DataFrame:
        """The anomaly table of a generation (the newest complete one)."""
        gen = self._newest() if gen is None else gen
        return self._current("anomaly", _ANOMALY, gen, self._manifest("moments", _MOMENTS, gen), "part").drop("part")

    def series(self, gen: int | None = None) -> DataFrame:
        """The overall series that the anomaly table of a generation stands on."""
        gen = self._newest() if gen is None else gen
        return self._current("by_hour", _BY_HOUR, gen, self._manifest("moments", _MOMENTS, gen), "part").drop("part")

    # -- writing ----------------------------------------------------------------------
    def _series(self, payments: DataFrame) -> DataFrame:
        m = moment_inputs(overall_from_payments(payments, self.minutes), self.minutes)
        # payments without a timestamp have no slot to be compared in
        part = F.floor(F.col("tod_key") * self.minutes / F.lit(60)).cast("int")
        return m.where(F.col(BUCKET).isNotNull()).withColumn("part", part).withColumnRenamed("tod_key", "slot")

    def _write(self, df: DataFrame, name: str, gen: int, key: str) -> None:
        df.hint("rebalance", key).sortWithinPartitions(key, BUCKET).write.partitionBy(key).parquet(f"{self.location}/{name}/gen={gen}")

    def rebuild(self, payments: DataFrame) -> int:
        """A new generation from all payments; returns its number."""
        return self._advance(payments, None)

    def refresh(self, payments: DataFrame, days: Sequence[_dt.date] | DataFrame) -> int:
        """A new generation in which ``days`` are as in ``payments`` (a removed day has none) and all else is as before."""
        if self._newest() is None:
            raise ValueError("an incremental refresh needs a first rebuild")
        return self._advance(payments, days)

    def _advance(self, payments: DataFrame, days: Sequence[_dt.date] | DataFrame | None) -> int:
        old_gen = None if days is None else self._newest()
        # a failed refresh may have left files under the next numbers
        names = ("by_day", "by_hour", "anomaly", "days", "moments", "change")
        gen = max((g for n in names for g in self._listed(n)), default=0) + 1
        scope = payments if days is None else _days_filter(payments, days, "event_ts")
        day_list = None if days is None else self._day_table(days)

        # the new rows of the days, and the rows that the last generation holds for them
        self._write(self._series(scope), "by_day", gen, "dt")
        new = self._table("by_day", _BY_DAY).where(F.col("gen") == gen).drop("gen")
        day_map = self._manifest("days", _DAYS, old_gen)
        if day_list is None:
            old = new.limit(0)
            kept_days = day_map.limit(0)
        else:
            touched_days = day_map.join(day_list, "dt", "left_semi")
            old = self._current("by_day", _BY_DAY, old_gen, touched_days, "dt")
            kept_days = day_map.join(day_list, "dt", "left_anti")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*_VALUES, "x_bp", "x_ct")]
        agree = same[0]
        for s in same[1:]:
            agree = agree & s
        both = old.alias("o").join(new.alias("n"), F.col(f"o.{BUCKET}") == F.col(f"n.{BUCKET}"), "full")
        changed = both.where(~(agree & F.col(f"o.{BUCKET}").isNotNull() & F.col(f"n.{BUCKET}").isNotNull()))
        sides = changed.select(F.inline(F.array(*[F.struct(
            F.lit(sign).alias("sign"), *[F.col(f"{side}.{c}").alias(c) for c in (BUCKET, *_VALUES, "x_bp", "x_ct", "dt", "slot", "part")])
            for side, sign in (("o", -1), ("n", 1))]))).where(F.col(BUCKET).isNotNull())
        change_path = f"{self.location}/change/gen={gen}"
        sides.write.parquet(change_path)
        sides = self.spark.read.parquet(change_path)

        # moments by difference
        sq = lambda c: F.col(c).cast(EXACT) * F.col(c).cast(EXACT)
        sign = F.col("sign")
        delta = sides.groupBy("slot", "part").agg(
            F.sum(sign).cast("bigint").alias("n"), F.sum(sign * F.col("x_bp")).alias("sx_bp"),
            F.sum(sign * sq("x_bp")).cast(EXACT).alias("sq_bp"), F.sum(sign * F.col("x_ct")).alias("sx_ct"),
            F.sum(sign * sq("x_ct")).cast(EXACT).alias("sq_ct"), F.lit(gen).alias("at"))
        before = self._manifest("moments", _MOMENTS, old_gen)
        after = before.unionByName(delta).groupBy("slot", "part").agg(
            *[F.sum(c).cast("bigint" if c in ("n", "sx_bp", "sx_ct") else EXACT).alias(c) for c in SUMS], F.max("at").alias("at"))
        touched = sides.select("part").distinct()  # at most 24 rows
        moved = touched.withColumn("_moved", F.lit(gen))
        after = after.where("n > 0").join(moved, "part", "left").withColumn("at", F.coalesce("_moved", "at")).select(*before.columns)

        # rows of the touched hours alone: what the last generation holds, without the changed buckets, and the new ones
        rest = self._current("by_hour", _BY_HOUR, old_gen, before.join(touched, "part", "left_semi"), "part")
        rest = rest.join(sides.where("sign < 0").select(BUCKET), BUCKET, "left_anti")
        rows = rest.unionByName(sides.where("sign > 0").drop("sign"))
        self._write(rows, "by_hour", gen, "part")
        rows = self._table("by_hour", _BY_HOUR).where(F.col("gen") == gen).drop("gen")
        own = rows.join(after.drop("at", "part"), "slot")
        own = own.select(BUCKET, "part", *_VALUES, (F.col("n") - 1).alias("n"), (F.col("sx_bp") - F.col("x_bp")).alias("sx_bp"),
                         (F.col("sq_bp") - sq("x_bp")).alias("sq_bp"), (F.col("sx_ct") - F.col("x_ct")).alias("sx_ct"),
                         (F.col("sq_ct") - sq("x_ct")).alias("sq_ct"))
        found = anomaly(finish_moments(own, keep=("part",)), keep=("part",))
        self._write(found, "anomaly", gen, "part")

        now = new.select("dt").distinct().withColumn("at", F.lit(gen))
        kept_days.select("dt", "at").unionByName(now).coalesce(1).write.parquet(f"{self.location}/days/gen={gen}")
        after.coalesce(1).write.parquet(f"{self.location}/moments/gen={gen}")  # the commit
        return gen

    def _day_table(self, days: Sequence[_dt.date] | DataFrame) -> DataFrame:
        if isinstance(days, DataFrame):
            return days.select(F.col("dt").cast("date").alias("dt")).where("dt is not null").distinct()
        return self.spark.createDataFrame([(d,) for d in sorted({d for d in days if d is not None})], "dt date")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete files that none of the newest ``keep`` generations names; returns the generations that lost files.
        An hour's rows may stay in an old generation for long; that generation's other files go only with it.

        Readers of a kept generation are not disturbed.
        """
        kept = self.generations()[-keep:]
        if not kept:
            return []
        used = set(kept)
        for name, schema in (("moments", _MOMENTS), ("days", _DAYS)):
            for g in kept:  # at most one row per slot or day
                used |= {r["at"] for r in self._manifest(name, schema, g).select("at").distinct().collect()}
        jvm = self.spark.sparkContext._jvm
        gone = set()
        for name in ("by_day", "by_hour", "anomaly", "days", "moments", "change"):
            for g in self._listed(name):
                if g not in used and g < kept[-1]:
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.location}/{name}/gen={g}")
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                    gone.add(g)
        return sorted(gone)
