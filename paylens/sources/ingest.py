"""Typed ingest of text-typed payment and game-event records.

The reference builds its silver tables from rows whose ``event_ts`` is an
ISO-8601 string and parses it with ``to_timestamp``.  Here the raw records
are read by Spark with an explicit all-string schema (no inference pass over
the data) and typed in one projection; timestamps become TIMESTAMP_NTZ (wall
clock, no session time zone).  A value that does not parse becomes NULL rather
than failing the job under ANSI mode, and its column is named in ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.sources.fixtures import GAME_EVENT_COLUMNS, PAYMENT_COLUMNS
from paylens.sources.sinks import overwrite_table, read_written, written_schema

PAYMENT_TYPES = {"event_id": "bigint", "event_ts": "timestamp_ntz", "amount": "double"}
GAME_EVENT_TYPES = {"event_id": "bigint", "event_ts": "timestamp_ntz"}
REJECTED = "rejected"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def typed(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to their types; ``rejected`` lists the columns whose text did not parse."""
    bad = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]))
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns],
                      bad.alias(REJECTED))


def rejects(typed_rows: DataFrame) -> DataFrame:
    """Rows with at least one unparsable value."""
    return typed_rows.where(F.size(REJECTED) > 0)


def write_text(df: DataFrame, path: str) -> None:
    """Write a typed table as JSON text records with ISO-8601 timestamps (the raw form of the tables)."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
    kinds = dict(df.dtypes)
    df.select(*[iso(c) if kinds[c].startswith("timestamp") else F.col(c).cast("string").alias(c)
                for c in df.columns]).write.json(path)


BROKEN = "_broken_line"
RECORD = "_record"
NOT_A_RECORD, WRONG_TYPE = "unreadable record", "value of the wrong type"


def read_records(spark: SparkSession, path: str, columns: list[str], types: dict[str, str], fmt: str = "json") -> DataFrame:
    """All records of text files, readable or not: typed columns, ``rejected``, and of what is not
    accepted the record as it was read (``_record``), if it is no record its line (``_broken_line``);
    ``source_file`` names the file.

    One scan with an explicit schema: a line that the format's parser cannot read comes
    back as text instead of a row of NULLs.
    """
    schema = T.StructType([*text_schema(columns).fields, T.StructField(BROKEN, T.StringType())])
    raw = spark.read.schema(schema).format(fmt).option("header", "true").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", BROKEN).load(path).select(*columns, BROKEN, F.col("_metadata.file_path").alias("source_file"))
    rows = typed(raw.withColumn(RECORD, F.struct(*columns)), types)
    text = F.when(F.col(BROKEN).isNotNull(), F.col(BROKEN)).when(F.size(REJECTED) > 0, F.to_json(RECORD))
    return rows.withColumn(RECORD, text)


def accepted_records(records: DataFrame) -> DataFrame:
    """The rows that are readable and whose every value has its type, without the ingest columns."""
    return records.where(F.col(RECORD).isNull()).drop(BROKEN, REJECTED, RECORD, "source_file")


def quarantined_records(records: DataFrame) -> DataFrame:
    """``(source_file, reason, columns, record)``: what was not accepted, as it was read.

    ``record`` is the line itself if it is no record, else its text values as JSON;
    ``columns`` names those whose value has not the column's type.
    """
    broken = F.col(BROKEN).isNotNull()
    return records.where(F.col(RECORD).isNotNull()).select(
        "source_file", F.when(broken, NOT_A_RECORD).otherwise(WRONG_TYPE).alias("reason"),
        F.col(REJECTED).alias("columns"), F.col(RECORD).alias("record"))


def ingest(spark: SparkSession, path: str, columns: list[str], types: dict[str, str], table_path: str,
           quarantine_path: str, ts_col: str = "event_ts", fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Read text records once into a day-partitioned table and a quarantine table; returns both read back.

    Every input line ends up in exactly one of them.
    """
    staged = f"{quarantine_path}-staged"
    records = read_records(spark, path, columns, types, fmt)
    # the parsed records are written once, so that the two tables cannot disagree about a line
    records.write.mode("overwrite").parquet(staged)
    records = spark.read.schema(records.schema).parquet(staged)
    good, bad = accepted_records(records), quarantined_records(records)
    overwrite_table(good, table_path, ts_col)
    bad.write.mode("overwrite").parquet(quarantine_path)
    return (read_written(spark, table_path, schema=written_schema(good, ts_col)).select(*columns),
            spark.read.schema(bad.schema).parquet(quarantine_path))


def _typed_rows(spark: SparkSession, path: str, columns: list[str], types: dict[str, str], fmt: str) -> DataFrame:
    """Typed rows with ``rejected``; a line that is no record is a row of NULLs that names all its columns."""
    rows = read_records(spark, path, columns, types, fmt)
    every = F.array(*[F.lit(c) for c in columns])
    return rows.withColumn(REJECTED, F.when(F.col(BROKEN).isNotNull(), every).otherwise(F.col(REJECTED))).drop(BROKEN, RECORD, "source_file")


def read_payments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _typed_rows(spark, path, PAYMENT_COLUMNS, PAYMENT_TYPES, fmt)


def read_game_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _typed_rows(spark, path, GAME_EVENT_COLUMNS, GAME_EVENT_TYPES, fmt)
