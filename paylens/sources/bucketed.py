"""Co-located join of events and customers through bucketed tables.

Run from the raw files, ``events ⋈ customer`` (when customer is too big to
broadcast) shuffles every event by ``user_id``.  Written once as tables
bucketed — and sorted — by the join keys with the same bucket count, the
sort-merge join reads matching buckets side by side: no exchange on either
side.  The tables are external tables whose files live in the cluster-shared
folder.

Hot users: a bucketed join cannot be split by AQE, so a user holding a third
of all events would be one bucket.  The key is salted: events carry
``salt = pmod(xxhash64(event_id), S)`` and each customer row is replicated
once per salt value; both sides are bucketed by (``user_id``, ``salt``), so a
hot user's events spread over S buckets while every event still meets its
customer row.  The customer side grows S-fold, which is small next to the
events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import unique_shared_path
from paylens.sources.fixtures import payments_from_events
from paylens.sources.tables import read_table

KEYS = ["user_id", "salt"]


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """``CREATE TABLE name USING parquet CLUSTERED BY (keys) SORTED BY (keys) INTO n BUCKETS``."""
    # one task per bucket, so a table has as many files as buckets
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed_sources(spark: SparkSession, sf_dir: str, buckets: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Events and customers written once as co-bucketed, salted tables.

    ``buckets`` and ``salt`` belong to the data: bytes of events / (buckets) is
    what a task reads and sorts (aim at 1 GB or less), and a hot user's share of
    the events / ``salt`` should not exceed that either.  The two table names are
    fixed: a new call replaces the tables of the last one.
    """
    base = unique_shared_path(spark, "bucketed")
    ev = read_table(spark, sf_dir, "events").withColumn(
        "salt", F.pmod(F.xxhash64("event_id"), F.lit(salt)).cast("int"))
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("user_id"), "c_nationkey",
        F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    return (write_bucketed(ev, "paylens_events_bucketed", KEYS, buckets, f"{base}/events"),
            write_bucketed(cu, "paylens_customer_bucketed", KEYS, buckets, f"{base}/customer"))


def silver_payments_bucketed(spark: SparkSession, sf_dir: str, buckets: int, salt: int) -> DataFrame:
    """``silver_payments`` computed over the co-bucketed tables."""
    ev, cu = bucketed_sources(spark, sf_dir, buckets, salt)
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    joined = (
        ev.join(cu, KEYS)  # equi-join on exactly the bucket columns: co-located
        .join(F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .select("event_id", "ts", "user_id", "event_type", "value", "props", "r_name")
    )
    return payments_from_events(joined)
