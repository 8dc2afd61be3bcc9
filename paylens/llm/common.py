"""Helpers shared by the operators: reads, working tables, byte-level words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.session import shared_dir

# ``[^\x20\x09-\x0D]+`` on UTF-8 bytes is exactly ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any store it can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` under the cluster's shared folder and read it back.

    Cuts the lineage: what is built on the result survives lost executors
    without recomputing the input.  The shuffle files of the finished job are
    dead from here on; Spark deletes them when the driver collects its garbage,
    which ``release`` asks for after a job that shuffled much.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(col: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(col, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))
