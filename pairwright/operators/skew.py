"""Building blocks that keep hot keys and global orders off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
    extra: Column | None = None,
    spread_by: Sequence[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``salts`` reducers.

    ``small`` is repeated once per salt, so use it where ``big`` has hot keys and ``small``
    has few rows per key. Only ``inner``, ``left``, ``left_semi`` and ``left_anti`` keep
    their meaning, because each row of ``big`` meets exactly one copy of ``small``. ``tasks`` deals
    both sides over so many tasks: where few bytes make many pairs, Spark would merge them by bytes.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    spread = [F.col(c) for c in (spread_by or big.columns)]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*keys, "_salt"]
    if tasks is not None:
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    if extra is None:
        return left.join(right, on, how).drop("_salt")
    if how == "inner":
        return left.join(right, on, how).where(extra).drop("_salt")
    raise ValueError("an extra condition needs an inner join")


def spread_tasks(spark: SparkSession) -> int:
    """Tasks for a join whose work grows faster than its bytes: several for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank_name: str = "rank") -> DataFrame:
    """Best ``k`` rows per key.

    Catalyst turns the rank filter into a per-task limit before the shuffle, so a hot key
    sends at most ``k`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)


def value_bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` cut points that split ``column`` into similar row counts.

    One small array reaches the driver; it only balances the work, so approximate is enough.
    """
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column, shares, 1000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def bucket_of(column: Column, bounds: Sequence[float]) -> Column:
    """Index of the value's bucket, rising with the value; a null is in the first.

    A sum and no lambda: from a join on a key made by a lambda Spark infers a filter on columns of the other side.
    """
    return sum((F.coalesce((column > b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def positions_by_bucket(
    df: DataFrame, bucket: str, order: Sequence[Column], name: str = "position",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact 1-based positions in a global (or per key) order.

    ``bucket`` must rise with the order. Rows are numbered inside a bucket and shifted by
    the row count of the lower buckets, so no task ever sorts the whole input or a hot key.
    """
    group = [*keys, bucket]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group).orderBy(*order)
    numbered = df.withColumn("_at", F.row_number().over(inside))
    return (
        numbered.join(shifts, group, "left")
        .withColumn(name, F.col("_at").cast("bigint") + F.col("_shift"))
        .drop("_at", "_shift")
    )


def running_sum_by_rank(
    df: DataFrame, keys: Sequence[str], rank: str, value: Column, name: str,
    rows_per_bucket: int = 100_000,
) -> DataFrame:
    """Cumulative sum down a ranking, split into rank ranges so a hot key is shared."""
    spread = df.withColumn("_part", F.floor((F.col(rank) - 1) / rows_per_bucket)).withColumn(
        "_value", value
    )
    group = [*keys, "_part"]
    sums = spread.groupBy(*group).agg(F.sum("_value").alias("_sum"))
    lower = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*group, F.coalesce(F.sum("_sum").over(lower), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("_run", F.sum("_value").over(inside))
        .join(shifts, group, "left")
        .withColumn(name, F.col("_run") + F.col("_shift"))
        .drop("_part", "_value", "_run", "_shift")
    )
