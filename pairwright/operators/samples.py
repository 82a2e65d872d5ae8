"""Splits and batches over a reproducible shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators.skew import bucket_of, positions_by_bucket, value_bounds


def shuffled_positions(df: DataFrame, key: str, seed: int = 42, shuffle: bool = True,
                       name: str = "position") -> DataFrame:
    """Exact 1-based positions in a seeded hash order (or in order of a numeric key).

    The order's buckets are the top bits of the hash, so they are even, known in advance and
    the same in every run; no task sorts the whole set.
    """
    if shuffle:
        placed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
        placed = placed.withColumn("_b", F.shiftright("_h", 52))
        return positions_by_bucket(placed, "_b", [F.col("_h"), F.col(key)], name).drop("_h", "_b")
    bounds = value_bounds(df, key, 32)
    placed = df.withColumn("_b", bucket_of(F.col(key), bounds))
    return positions_by_bucket(placed, "_b", [F.col(key)], name).drop("_b")


def split_dataset(df: DataFrame, key: str, test_share: float = 0.1, validation_share: float = 0.1,
                  seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Adds ``position`` and ``split``: train first, then val, then test.

    Sizes are floor(n * share) for test and val and the rest for train.
    """
    positions = shuffled_positions(df, key, seed, shuffle)
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    test, validation = F.floor(n * test_share), F.floor(n * validation_share)
    train: Column = n - test - validation
    split = (
        F.when(F.col("position") <= train, "train")
        .when(F.col("position") <= train + validation, "val").otherwise("test")
    )
    return positions.withColumn("split", split)


def make_batches(df: DataFrame, key: str, batch_rows: int = fv.BATCH_ROWS, seed: int = 42,
                 shuffle: bool = False) -> DataFrame:
    """Adds ``batch_id`` of consecutive rows; only the last batch may be short."""
    return shuffled_positions(df, key, seed, shuffle).withColumn(
        "batch_id", F.floor((F.col("position") - 1) / batch_rows)
    )
