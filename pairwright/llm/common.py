"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import scratch_path

#: Between two words of a shingle: anything that is neither a letter nor a digit.
WORD_GAP = r"[^\p{L}\p{N}]+"
SHINGLE_WORDS = 5
#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(column, F.lit(""))


def words_of(text: Column) -> Column:
    """Lower-case words (letters and digits) of a text, as an array without empty strings."""
    return F.array_remove(F.split(F.lower(text_of(text)), WORD_GAP), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a side whose counted ``rows`` are few; else Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def exploded_shingles(df: DataFrame, words: str, width: int, keep: list[str], hashed: str) -> DataFrame:
    """One row per run of ``width`` consecutive words with its 64-bit hash; repeated runs stay."""
    w = F.col(words)
    runs = F.arrays_zip(*[
        (w if i == 0 else F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1)))).alias(f"w{i}") for i in range(width)
    ])
    names = [f"w{i}" for i in range(width)]
    return (
        df.select(*keep, F.inline(runs).alias(*names))
        .where(F.col(names[-1]).isNotNull())
        .select(*keep, *names, F.xxhash64(*names).alias(hashed))
    )


def same(left: Column, right: Column) -> Column:
    """Equality that also holds between two nulls."""
    return left.eqNullSafe(right)


def bound_batches(spark: SparkSession, size: str = "16m") -> None:
    """Limit an Arrow batch by its bytes, so that a run of very long texts does not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value: Column, body) -> Column:
    """``body`` of a value computed once a row.

    A lambda variable, unlike a named column, stays computed once when Spark pushes a filter over it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins (one entry more than texts)."""
    whole = texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    values = whole.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
