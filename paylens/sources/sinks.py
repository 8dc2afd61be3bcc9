"""Table sinks: overwrite (CTAS) and append, partitioned by day.

Tables are parquet directories partitioned by ``dt`` (the calendar day of the
event or bucket), laid out by a REBALANCE shuffle on the day.  Day partitions give the window-restricted operators
partition pruning: their join on ``dt`` against the tiny windows table turns
into a dynamic-partition-pruning filter on the scan, so an incident query reads
one or two days, not the whole history.  Rows are clustered by time inside each
partition so parquet row-group statistics prune the time range further.

Writes go through Spark's file committer, so a failed or retried task never
leaves partial files in the visible table.  Overwriting a *path* is not a safe
replace: Spark removes the old files before it commits the new ones (with
``dynamic``, only those of the partitions it writes; a day without rows any more
keeps its files).  Replacing a *named* table is: the new files go to a version of
their own and the name is moved in one catalog step once they are complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.session import unique_shared_path

PARTITION_COL = "dt"


def _with_day(df: DataFrame, ts_col: str) -> DataFrame:
    if PARTITION_COL in df.columns:
        return df
    return df.withColumn(PARTITION_COL, F.to_date(ts_col))


def _layout(df: DataFrame, ts_col: str, cluster: bool) -> DataFrame:
    if cluster:
        # REBALANCE on the day: one shuffle whose output partitions AQE sizes
        # from the map statistics (spark.sql.adaptive.advisoryPartitionSizeInBytes)
        # — a hot day holding a third of all rows is split over many tasks,
        # small days are coalesced — with no sampling pass over the input
        # (a range repartition would re-run the whole upstream to sample it).
        # Each task then holds few days, so files per day stay few and large.
        df = df.hint("rebalance", PARTITION_COL)
    # Time-sorted inside each task: tight row-group min/max on the time column.
    return df.sortWithinPartitions(PARTITION_COL, ts_col)


def overwrite_table(df: DataFrame, path: str, ts_col: str, dynamic: bool = False, cluster: bool = True) -> None:
    """``CREATE OR REPLACE TABLE … AS SELECT`` as a day-partitioned write."""
    out = _layout(_with_day(df, ts_col), ts_col, cluster)
    writer = out.write.mode("overwrite").partitionBy(PARTITION_COL)
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_table(df: DataFrame, path: str, ts_col: str, cluster: bool = True) -> None:
    """``INSERT INTO`` in one job (no client-side batching)."""
    _layout(_with_day(df, ts_col), ts_col, cluster).write.mode("append").partitionBy(PARTITION_COL).parquet(path)


def written_schema(df: DataFrame, ts_col: str) -> T.StructType:
    """Schema of the files that :func:`overwrite_table` writes for ``df``, the day last."""
    s = _with_day(df, ts_col).schema
    return T.StructType([f for f in s if f.name != PARTITION_COL] + [s[PARTITION_COL]])


def read_written(spark: SparkSession, path: str, keep_partition: bool = False,
                 schema: T.StructType | None = None) -> DataFrame:
    """Read a table written by this module; drop the partition column unless asked.

    An empty write leaves no file to infer a schema from: pass ``schema``
    (:func:`written_schema`) wherever the table may be empty.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if keep_partition else df.drop(PARTITION_COL)


# -- named tables -----------------------------------------------------------------
#
# A named table is a catalog view over one folder of immutable versions:
# ``<base>/v=<n>``.  A version is written and committed first; then one catalog step
# (CREATE OR REPLACE VIEW) moves the name.  A reader resolves the name before or after
# that step and finds a complete version either way; the files of earlier versions stay
# until :func:`vacuum_named` removes them, so readers that are still at work finish.
# The view reads the version's folder, so partitions are found without MSCK.

_BASE, _VERSION = "paylens.base", "paylens.version"


def _view_properties(spark: SparkSession, name: str) -> dict[str, str]:
    if not spark.catalog.tableExists(name):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def _version_path(base: str, version: int) -> str:
    return f"{base}/v={version}"


def _publish(spark: SparkSession, name: str, base: str, version: int, schema: T.StructType) -> DataFrame:
    """The catalog step: ``name`` is version ``version`` from now on."""
    cols = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema)
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{_BASE}' = '{base}', '{_VERSION}' = '{version}') "
              f"AS SELECT {cols} FROM parquet.`{_version_path(base, version)}`")
    return spark.table(name)


def replace_named(df: DataFrame, name: str, ts_col: str) -> DataFrame:
    """``CREATE OR REPLACE TABLE name AS SELECT``, day-partitioned, without a gap for readers.

    ``df`` may read the named table itself: its files are not touched.  One writer per
    name is assumed, as with any table without a transaction log; readers are free.
    """
    spark = df.sparkSession
    before = _view_properties(spark, name)
    base = before.get(_BASE) or unique_shared_path(spark, name.split(".")[-1])
    version = int(before.get(_VERSION, 0)) + 1
    while path_exists(spark, _version_path(base, version)):  # left by a replace that failed before its catalog step
        version += 1
    schema = written_schema(df, ts_col)
    overwrite_table(df, _version_path(base, version), ts_col)
    if not _has_files(spark, _version_path(base, version)):
        # a table without rows: one file without rows, which carries the schema (and makes no day folder)
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(_version_path(base, version))
    return _publish(spark, name, base, version, schema)


def append_named(df: DataFrame, name: str, ts_col: str) -> DataFrame:
    """``INSERT INTO name`` in one job: its files are committed together into the current version."""
    spark = df.sparkSession
    now = _view_properties(spark, name)
    if _BASE not in now:
        raise ValueError(f"{name} was not made by replace_named")
    columns = [c for c in spark.table(name).columns]
    out = _with_day(df, ts_col).select(*columns)
    _layout(out, ts_col, True).write.mode("append").partitionBy(PARTITION_COL).parquet(
        _version_path(now[_BASE], int(now[_VERSION])))
    return spark.table(name)


def named_versions(spark: SparkSession, name: str) -> list[int]:
    """Versions of a named table whose files are there, oldest first."""
    base = _view_properties(spark, name)[_BASE]
    fs, path, jvm = _fs(spark, base)
    return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))


def vacuum_named(spark: SparkSession, name: str, keep: int = 2) -> list[int]:
    """Delete versions older than the newest ``keep`` (the current one always stays); returns them.

    Call it when no reader of those versions is at work any more.
    """
    now = _view_properties(spark, name)
    old = [v for v in named_versions(spark, name) if v <= int(now[_VERSION]) - max(1, keep)]
    for v in old:
        fs, path, _ = _fs(spark, _version_path(now[_BASE], v))
        fs.delete(path, True)
    return old


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def _has_files(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return any(not s.getPath().getName().startswith("_") for s in fs.listStatus(p))


# -- ordered tables ---------------------------------------------------------------

def overwrite_ordered(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """``CREATE TABLE … AS SELECT … ORDER BY`` as a table: files hold disjoint ranges of the first ``order`` column.

    A range partitioning by that column alone (equal values share a file) and a sort
    inside the files; no single task sorts the table.  ``files`` bounds their number.
    """
    parted = df.repartitionByRange(files, order[0]) if files else df.repartitionByRange(order[0])
    parted.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
