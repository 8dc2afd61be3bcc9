"""Benchmark decontamination (operator 7), in DataFrame operations only.

Finds test items inside documents, however long: an item is contained if at
least ``percent`` of its distinct ``width``-word shingles occur in the document.

*Size-partitioned MinHash.*  One hash orders all shingles.  Items are
partitioned by size (powers of two of their number of shingles) and an item's
sketch is its ``s`` smallest hashes, with ``s`` set per partition: an item of
``n`` shingles may miss ``floor(n * (100 - percent) / 100)`` of them, so among
one more than that at least one must occur in a containing document, and ``s``
is that number for the largest item of the partition.  A fixed-length sketch of
a long document would lose a short item (its similarity to the document tends
to zero); a sketch on the item's side loses none, and documents need none: their
shingles are looked up as they stream by, those beyond the largest sketch hash
at once discarded.

*Verification.*  Candidate documents are read again and the shingles
themselves, as text, are intersected with the item's.

The sketch table is broadcast only if its counted rows stay within
``MAX_BROADCAST_ROWS``; a larger one is joined by shuffle.

Results: words are lower-cased runs of characters other than ASCII punctuation
and white space.  A text with fewer words than ``width`` has its whole word
sequence as its only shingle; a NULL or blank one has none and neither contains
nor is contained.  Rows without id are matched like any other; repeated rows
give one result per ``(doc_id, item_id)``, with the largest overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.llm.common import written

WIDTH, PERCENT = 5, 80
MAX_BROADCAST_ROWS = 1_000_000  # two longs each: 16 MB of data

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(w: Column, width: int, make: Callable[..., Column], kind: str) -> Column:
    """``make(word, ...)`` of every run of ``width`` words; of the whole sequence if shorter."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: make(*[F.get(w, i + j) for j in range(width)]))
    return F.when(n >= width, runs).when(n > 0, F.array(make(F.array_join(w, " ")))).otherwise(
        F.array().cast(f"array<{kind}>"))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    return _shingles(w, width, F.xxhash64, "bigint")


def shingle_texts(w: Column, width: int = WIDTH) -> Column:
    return _shingles(w, width, lambda *x: F.concat_ws(" ", *x), "string")


def item_sketches(items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(item, h)`` for ``(item, words)`` rows: the sketch of every item."""
    x = items.select("item", F.array_distinct(shingle_hashes(F.col("words"), width)).alias("hs")).where(F.size("hs") > 0)
    x = x.withColumn("_n", F.size("hs")).withColumn("_part", F.floor(F.log2("_n")))
    # the largest item of a size class; at most 31 classes
    largest = x.groupBy("_part").agg(F.max("_n").alias("_most"))
    x = x.join(F.broadcast(largest), "_part")
    x = x.withColumn("_s", F.floor(F.col("_most") * (100 - percent) / 100).cast("int") + 1)
    return x.select("item", F.explode(F.slice(F.array_sort("hs"), F.lit(1), F.col("_s"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, row, item_id, n_item, n_shared)`` of ``(doc_id, text)`` rows and ``(item_id, text)`` rows.

    ``row`` is a hash of the text, so that rows without ``doc_id`` can be told apart.
    """
    tests = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("words"))
    tests = tests.dropDuplicates(["item"])
    sketch = written(item_sketches(tests, width, percent), "item-sketches")
    size, highest = sketch.agg(F.count(F.lit(1)), F.max("h")).first()
    if size <= MAX_BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    probe = d.select("row", words(F.col("text")).alias("w")).select("row", F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
    found = probe.where(F.col("h") <= F.lit(highest)).join(sketch, "h").select("row", "item").distinct()
    # written: the planner then knows how few candidates there are when it joins the texts to them
    found = written(found, "candidates")
    full = tests.select("item", "item_id", F.array_distinct(shingle_texts(F.col("words"), width)).alias("parts"))
    pairs = d.join(found, "row").select("doc_id", "row", "item", words(F.col("text")).alias("w")).select(
        "doc_id", "row", "item", shingle_texts(F.col("w"), width).alias("has"))
    both = F.size(F.array_intersect("has", "parts")).cast("long")
    return (pairs.join(full, "item")
            .select("doc_id", "row", "item_id", F.size("parts").cast("long").alias("n_item"), both.alias("n_shared"))
            .where(F.col("n_shared") * 100 >= F.col("n_item") * percent))


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that contain a benchmark item: ``doc_id, item_id, n_item, n_shared, containment``."""
    x = contained_items(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return x.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m")).select(
        "doc_id", "item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))
