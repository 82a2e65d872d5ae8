"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Containment is asymmetric (a short item in a long document), so the smaller side is sketched and
the larger side is only asked whether it holds the sketched shingles: the share of an item's
MinHash sketch found in a document estimates the item's containment, however long the document
is. Items are partitioned by their number of shingles, and each partition has its own sketch length
and its own number of hits that makes a candidate:

* up to ``EXACT_SHINGLES`` distinct shingles: with ``m`` shingles that may be missing, the sketch is
  the ``m + SPARE`` smallest hashes and ``sketch - m`` hits are needed, so no item is missed;
* above: the ``SAMPLE`` smallest hashes, ``SAMPLE_HITS`` hits (an item at the threshold is missed
  with a probability below 1e-9).

Candidates are verified by exact containment of the items' word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import (
    SHINGLE_WORDS, broadcast_if_small, exploded_shingles, same, stored, words_of,
)

EXACT_SHINGLES = 256
SPARE = 4
SAMPLE = 48
SAMPLE_HITS = 16


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, width, words): an item shorter than five words is one shingle of all its words."""
    words = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words"))
    return words.where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(SHINGLE_WORDS)))


def _shingles(rows: DataFrame, widths: list[int], key: str, by_width: bool = False) -> DataFrame:
    """(key, width, run, h): every shingle of the widths that occur among the items."""
    parts = None
    for width in widths:
        own = rows.where(F.col("width") == width) if by_width else rows
        part = exploded_shingles(own, "words", width, [key], "h").select(
            key, F.lit(width).alias("width"), F.concat_ws(" ", *[f"w{i}" for i in range(width)]).alias("run"), "h")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold_pct: int = 80, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) with containment at or above the threshold.

    Words are lower-cased runs of letters and digits; shingles are distinct runs of five words (all
    words of a shorter item). Null and empty texts hold nothing and are held by nothing. Rows with one
    document id count as one document, rows with one item id as one item; a null id is an id.
    Extra columns are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_id, item_text)
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # five values at most
    if not widths:
        return spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, "
                                         f"item_id {benchmark.schema[item_id].dataType.simpleString()}, "
                                         "n_shared long, n_shingles long, containment double")
    grams = stored(_shingles(items, widths, "item", by_width=True).distinct(), "item-shingles")
    sizes = grams.groupBy("item").agg(F.count(F.lit(1)).alias("q"))
    by_hash = Window.partitionBy("item").orderBy("h", "run")
    may_miss = F.col("q") - F.ceil(F.col("q") * threshold_pct / 100)
    exact = F.col("q") <= EXACT_SHINGLES
    ranked = grams.withColumn("at", F.row_number().over(by_hash)).withColumnRenamed("item", "own")
    sketch = (
        ranked.join(sizes, same(F.col("own"), F.col("item")))
        .withColumn("length", F.when(exact, F.least(F.col("q"), may_miss + SPARE)).otherwise(F.lit(SAMPLE)))
        .withColumn("needed", F.when(exact, F.col("length") - may_miss).otherwise(F.lit(SAMPLE_HITS)))
        .where(F.col("at") <= F.col("length"))
        .select("item", "width", "h", "needed")
    )
    sketch = stored(sketch, "item-sketch")
    sketch_rows, gram_rows = sketch.count(), grams.count()

    words = docs.select(F.col(doc_id).alias("doc"), words_of(F.col(text)).alias("words"))
    runs = None
    for width in widths:
        part = exploded_shingles(words, "words", width, ["doc"], "h").select("doc", F.lit(width).alias("width"), "h")
        runs = part if runs is None else runs.unionByName(part)
    hits = runs.join(broadcast_if_small(sketch, sketch_rows), ["width", "h"]).groupBy("doc", "item", "needed", "h").agg(
        F.lit(1).alias("one"))
    candidates = stored(
        hits.groupBy("doc", "item", "needed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("needed"))
        .select("doc", "item"), "candidates")

    wanted = candidates.select(F.col("doc").alias("wanted")).distinct()
    suspects = words.join(broadcast_if_small(wanted, candidates.count()), same(F.col("doc"), F.col("wanted")), "left_semi")
    runs = _shingles(suspects, widths, "doc")
    found = (
        runs.join(broadcast_if_small(grams.drop("h"), gram_rows), ["width", "run"])
        .groupBy("doc", "item", "width", "run").agg(F.lit(1).alias("one"))
        .groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    )
    pairs = candidates.select(F.col("doc").alias("c_doc"), F.col("item").alias("c_item"))
    held = found.join(pairs, same(F.col("doc"), F.col("c_doc")) & same(F.col("item"), F.col("c_item")), "left_semi")
    q = sizes.select(F.col("item").alias("q_item"), "q")
    return (
        held.join(q, same(F.col("item"), F.col("q_item")))
        .where(F.col("n_shared") * 100 >= F.col("q") * threshold_pct)
        .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shared",
                F.col("q").alias("n_shingles"), (F.col("n_shared") / F.col("q")).alias("containment"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold_pct: int = 80) -> DataFrame:
    """``docs`` (all columns) without the documents that contain a benchmark item."""
    leaked = contained_items(docs, benchmark, threshold_pct).select(F.col("doc_id").alias("_leaked_id")).distinct()
    return docs.join(leaked, same(docs["doc_id"], leaked["_leaked_id"]), "left_anti")
