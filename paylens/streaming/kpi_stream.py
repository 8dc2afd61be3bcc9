"""Structured Streaming twins of the KPI cube.

Two forms:

* :func:`run_partial_kpi_stream` — every micro-batch writes its own partial cube
  (sums and counts per bucket and segment) under its batch id, and the cube is
  the sum of the partials.  No state, no watermark: every row counts however late
  it comes, open buckets are there at once, and the result does not depend on how
  files were split into batches.  A replayed batch overwrites its own partial.
* :func:`run_kpi_stream` — watermarked windows in append mode: each bucket is
  emitted once, when it closes.  Buckets that are still open at the end are not
  in the sink, and rows behind the watermark are dropped.

The reference rebuilds ``gold_kpi_5m`` in batch after every change.  The
streaming form keeps the cube current incrementally: raw events arrive as
files, are enriched by a stream-static join with the customer → region
dimension, and are aggregated into event-time windows with a watermark, so the
state of a bucket is dropped once no more late rows can reach it and each
bucket is appended to the sink exactly once when it closes.

Late rows: Spark drops input older than the watermark of the *previous*
micro-batch; rows arriving in the batch that first moves the watermark past
their bucket still count (tested in ``tests/test_sinks_stream_plans.py``).

``withWatermark`` needs a TIMESTAMP (instant) column; the fixture's
TIMESTAMP_NTZ wall clock is mapped to the instant of that wall clock in UTC
with ``make_timestamp(..., 'UTC')`` — independent of the session time zone —
and window boundaries, being computed on epoch time, line up with the batch
cube's NTZ buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.config import BUCKET_MINUTES, DIMS
from paylens.functions.expr import bucket_start, is_fail, is_success, micros, ratio, round_half_up, rounded_micros
from paylens.operators.cube import BUCKET
from paylens.sources.fixtures import payments_from_events


def utc_instant(ts_ntz: str) -> F.Column:
    c = F.col(ts_ntz)
    secs = F.date_part(F.lit("SECOND"), c)  # seconds with microsecond fraction
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), secs, F.lit("UTC"))


def kpi_stream(events_stream: DataFrame, regions: DataFrame, minutes: int = BUCKET_MINUTES,
               watermark: str = "10 minutes") -> DataFrame:
    """Streaming ``gold_kpi_5m`` (append mode: one row per closed bucket × segment)."""
    pay = payments_from_events(events_stream, regions)
    pay = pay.withColumns({"_ts": utc_instant("event_ts"), "_bucket": bucket_start("event_ts", minutes)})
    ok = is_success()
    g = (
        pay.withWatermark("_ts", watermark)
        .groupBy(F.window("_ts", f"{int(minutes)} minutes"), *DIMS)
        .agg(
            F.min("_bucket").alias(BUCKET),
            F.sum(F.when(ok, micros("amount")).otherwise(F.lit(0).cast("bigint"))).alias("_rev"),
            F.count(F.lit(1)).alias("pay_attempts"),
            F.count_if(ok).alias("pay_success"),
            F.count_if(is_fail()).alias("pay_fail"),
        )
    )
    return g.select(
        BUCKET, *DIMS,
        rounded_micros("_rev").alias("revenue"),
        "pay_attempts", "pay_success", "pay_fail",
        round_half_up(ratio("pay_success", "pay_attempts"), 4).alias("pay_success_rate"),
    )


def partial_kpi(payments: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Mergeable cube rows: sums and counts, nothing rounded."""
    ok = is_success()
    return payments.groupBy(bucket_start("event_ts", minutes).alias(BUCKET), *DIMS).agg(
        F.sum(F.when(ok, micros("amount")).otherwise(F.lit(0).cast("bigint"))).alias("rev"),
        F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("success"), F.count_if(is_fail()).alias("fail"))


def merged_kpi(partials: DataFrame) -> DataFrame:
    """The cube from partial cubes of disjoint sets of payments."""
    g = partials.groupBy(BUCKET, *DIMS).agg(
        F.sum("rev").alias("_rev"), F.sum("attempts").alias("pay_attempts"),
        F.sum("success").alias("pay_success"), F.sum("fail").alias("pay_fail"))
    return g.select(BUCKET, *DIMS, rounded_micros("_rev").alias("revenue"), "pay_attempts", "pay_success", "pay_fail",
                    round_half_up(ratio("pay_success", "pay_attempts"), 4).alias("pay_success_rate"))


def _events_stream(spark: SparkSession, events_dir: str, events_glob: str, max_files_per_trigger: int | None) -> DataFrame:
    schema = spark.read.parquet(f"{events_dir.rstrip('/')}/{events_glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", events_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(events_dir)


def run_partial_kpi_stream(spark: SparkSession, events_dir: str, events_glob: str, regions: DataFrame,
                           out_path: str, checkpoint_path: str, minutes: int = BUCKET_MINUTES,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """Process everything available now; returns the merged cube of all batches so far."""
    pay = payments_from_events(_events_stream(spark, events_dir, events_glob, max_files_per_trigger), regions)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        partial_kpi(batch, minutes).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (pay.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return merged_kpi(spark.read.parquet(out_path))


def run_kpi_stream(spark: SparkSession, events_dir: str, events_glob: str, regions: DataFrame,
                   out_path: str, checkpoint_path: str, minutes: int = BUCKET_MINUTES,
                   watermark: str = "10 minutes", max_files_per_trigger: int | None = None) -> None:
    """Process everything available now into a parquet sink, then stop.

    The checkpoint (offsets + aggregation state) lives in the shared folder, so
    a restarted query resumes where it stopped instead of re-reading history.
    """
    stream = _events_stream(spark, events_dir, events_glob, max_files_per_trigger)
    q = (
        kpi_stream(stream, regions, minutes, watermark)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
