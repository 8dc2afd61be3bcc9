"""Corpus pipeline over ``documents``: five stages, each written and reread.

1. ``quality``      — documents that the ordinal classifier does not give the top
   grade go;
2. ``near_dup``     — one document of each class of near duplicates stays (five-word
   shingles, similarity 0.8);
3. ``decontaminate`` — documents that contain a benchmark item go;
4. ``pii``          — personal data is replaced by its kind;
5. ``mix``          — the remaining words are mixed to the sources' target weights, one
   row per drawn block.

The first four return the columns of ``documents`` (extra ones included).  The
second works on rows, told apart by ``doc_id`` and a hash of the text: rows that
share a ``doc_id`` are one document, rows without one belong to the class of their
words, and of each class one row stays, that of the smallest ``doc_id``.  A row
without ``doc_id`` and without words links with nothing and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.common import table, written
from paylens.llm.components import components
from paylens.llm.decontaminate import contained_items
from paylens.llm.mixing import mix
from paylens.llm.near_dup import near_duplicates
from paylens.llm.pii import pii_spans, redacted
from paylens.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.where("text is not null").select("text").distinct().select(key.alias("doc_id"), "text")
    texts = written(texts, "near-dup-texts", release=True)
    alike = near_duplicates(texts, width=5, percent=80).where("n_shingles > 0").select(
        F.col("doc_id").alias("_key"), F.col("component_id").alias("_comp"))
    rows = docs.groupBy("doc_id", key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).join(alike, "_key", "left")
    rows = written(rows.where("doc_id is not null or _comp is not null"), "near-dup-rows")

    # rows that share a doc_id are one document, whatever their texts
    ids = rows.where("doc_id is not null and _comp is not null").select("doc_id", "_comp").distinct()
    several = ids.groupBy("doc_id").agg(F.min("_comp").alias("b"), F.max("_comp").alias("_most")).where("b < _most")
    links = ids.join(several, "doc_id").where("_comp > b").select(F.col("_comp").alias("a"), "b").distinct()
    root = components(written(links, "near-dup-links"))
    rows = rows.join(root, rows["_comp"] == root["node"], "left").withColumn("_class", F.coalesce("root", "_comp"))
    rows = written(rows.select("doc_id", "_key", "_n", "_comp", "_class"), "near-dup-classes")
    of_id = rows.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("_class").alias("_of_id"))
    rows = rows.join(of_id, rows["doc_id"] == of_id["_id"], "left").withColumn("_class", F.coalesce("_class", "_of_id"))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", F.col("_comp").isNull().alias("y"), "_key", "_n"))
    own = F.when(F.col("_class").isNull(), F.col("doc_id"))  # documents without words are classes of their own
    kept = rows.groupBy("_class", own.alias("_own")).agg(first.alias("k"))
    kept = written(kept.select(F.col("k.doc_id").alias("_id"), F.col("k._key").alias("_text"), "k._n"), "near-dup-kept")

    def matched(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        return x.join(y, x["doc_id"].eqNullSafe(y["_id"]) & (x["_key"] == y["_text"]), how)

    gone = matched(rows, kept, "left_anti").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_text"))
    gone = written(gone, "near-dup-gone")  # with a known size, the planner picks the join
    again = written(kept.where("_n > 1").select("_id", "_text"), "near-dup-again")
    left = matched(docs.withColumn("_key", key), gone, "left_anti")
    row = F.struct(*docs.columns)
    once = matched(left, again, "left_semi").groupBy("doc_id", "_key").agg(
        F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return matched(left, again, "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contained_items(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    leaks = written(found.select(F.col("row").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaks["_leak"], "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii_spans(docs, out="_pii_spans")
    text = F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col("_pii_spans")))
    new = found.withColumn("text", text).drop("_pii_spans")
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dup", near_dup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("mix", mixture),
]

# The first stage applies a fitted model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
