"""Bounded labelled samples on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import text_of


#: Tasks over which a sample is spread.
SAMPLE_PARTS = 32


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")).cast("long") % modulus


def labelled_ids(labels: DataFrame, label: str, allowed: Column, per_class: int) -> DataFrame:
    """(doc_id, y, at): at most ``per_class`` labelled ids of each class, numbered by a hash of the id.

    Repeated labels count once; an id labelled both 0 and 1 teaches neither and is left out.
    """
    y = F.col(label).cast("int")
    known = (
        labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("_other")).where("y = _other").drop("_other")
    )
    hashed = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = [known.where(F.col("y") == k).orderBy(*hashed).limit(per_class) for k in (0, 1)]
    at = F.row_number().over(Window.partitionBy("y").orderBy(*hashed))  # over the chosen ids only
    return first[0].unionByName(first[1]).withColumn("at", at)


def sampled_texts(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, y, at, text) with the whole text of each sampled id; of repeated rows the least text counts."""
    texts = docs.select(docs[doc_id].alias("doc_id"), text_of(docs[text]).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id")  # the ids are bounded by per_class
    return found.groupBy("doc_id", "y", "at").agg(F.min("text").alias("text")).repartition(SAMPLE_PARTS, "doc_id")


def window(text: Column, doc_id: Column, chars: int) -> Column:
    """The text, or of a longer one ``chars`` characters at a hashed place."""
    start = F.pmod(F.xxhash64(doc_id), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1
    return F.substring(text, start, F.lit(chars))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(id_bucket(doc_id, modulus) == rest, F.lit(False))
