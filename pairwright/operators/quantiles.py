"""Exact percentiles without holding a group in one task, guided by mergeable sketches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.session import cut_lineage

#: A stretch of values with at most this many rows is ordered in one task.
ROW_BUDGET = 1_000_000
#: Sketch size and grid: ranks are estimated to about 0.4 %, new edges stand one or two hundredths off the wanted rank.
SKETCH_SIZE = 800
STEPS = 100


def _slot(edges: Column, value: Column) -> Column:
    """2 i between the edges i - 1 and i, 2 i + 1 on the edge i."""
    lower = F.array_position(F.sort_array(F.array_append(edges, value)), value) - 1
    return 2 * lower + F.array_contains(edges, value).cast("int")


def _counted(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _slot, _in, _before): exact rows of each slot and of all lower ones; at most a few hundred a group."""
    lower = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_in")).withColumn(
        "_before", F.coalesce(F.sum("_in").over(lower), F.lit(0)))


def _new_edges(placed: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _more): values on both sides of each wanted rank of slots that hold too many rows."""
    grid = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    slots = wide.select(*keys, "_slot").distinct()
    sketched = (
        placed.join(F.broadcast(slots) if keys == ["_all"] else slots, [*keys, "_slot"])
        .groupBy(*keys, "_slot").agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH_SIZE)).alias("_sketch"))
        .select(*keys, "_slot", F.kll_sketch_get_quantile_double("_sketch", grid).alias("_grid"))
    )
    step = F.floor((F.col("_rank") - F.col("_before")) / F.col("_in") * STEPS).cast("int")
    around = F.array(*[F.get("_grid", at) for at in (F.greatest(step - 1, F.lit(0)), F.least(step + 2, F.lit(STEPS)))])
    return (
        wide.join(sketched, [*keys, "_slot"]).select(*keys, F.explode(around).alias("_e"))
        .groupBy(*keys).agg(F.collect_set("_e").alias("_more"))
    )


def _of_small_groups(source: DataFrame, keys: list[str], shares: Sequence[float]) -> DataFrame:
    """The same percentiles where every group may be ordered in one task: rows are dealt and ordered once."""
    own = Window.partitionBy(*keys)
    at = F.col("share") * (F.col("_n") - 1)
    return (
        source.withColumn("_rank", F.row_number().over(own.orderBy("_v")) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(own))
        .withColumn("share", F.explode(F.filter(
            F.array(*[F.lit(float(s)) for s in shares]),
            lambda s: F.col("_rank").isin(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1))))))
        .groupBy(*keys, "share").agg(
            F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max(at - F.floor(at)).alias("_fraction"))
        .select(*keys, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_fraction")).alias("value"))
    )


def exact_percentiles(
    df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), row_budget: int = ROW_BUDGET,
) -> DataFrame:
    """Linear-interpolated percentiles, one row per (group, share): ``by..., share, value``.

    Rows are counted between edges, at first none. While the stretch around a wanted rank holds more than
    ``row_budget`` rows, a sketch of it gives two new edges, which leave about three hundredths of it, however the values
    lie; counts are exact, so a sketch only balances work. In the end only these stretches are ordered; a value
    on an edge, however frequent, needs no order. Rows themselves are never shuffled before that.
    Nulls and NaN are left out.
    """
    keys = list(by) or ["_all"]
    source = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    edges = cut_lineage(sizes.withColumn("_edges", F.array().cast("array<double>")))
    targets = (
        edges.select(*keys, "_n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
        .withColumn("_at", F.col("share") * (F.col("_n") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
        .select(*keys, "share", (F.col("_at") - F.floor("_at")).alias("_fraction"), "_rank")
    )
    if by and (edges.agg(F.max("_n")).first()[0] or 0) <= row_budget:
        return _of_small_groups(source, keys, shares)
    while True:
        # without keys the edges are one row
        placed = source.join(edges if by else F.broadcast(edges), keys).withColumn("_slot", _slot(F.col("_edges"), F.col("_v")))
        counts = cut_lineage(_counted(placed, keys))
        located = targets.join(counts, keys).where(
            (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
        wide = located.where((F.col("_slot") % 2 == 0) & (F.col("_in") > row_budget))
        if wide.isEmpty():
            break
        edges = cut_lineage(edges.join(_new_edges(placed, wide, keys), keys, "left").select(
            *keys, "_n", F.array_sort(F.array_union("_edges", F.coalesce("_more", F.array().cast("array<double>")))).alias("_edges")))
    # at most two slots a share and group; without keys they go to the rows, which would else gather by slot
    wanted = located.select(*keys, "_slot", "_before").distinct()
    wanted = wanted if by else F.broadcast(wanted)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        placed.join(wanted, [*keys, "_slot"]).groupBy(*keys, "_slot", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
        .select(*keys, "_slot", "_v", "_end", (F.col("_end") - F.col("_c")).alias("_start"))
    )
    picked = located.select(*keys, "share", "_slot", "_rank", "_fraction").join(ordered, [*keys, "_slot"]).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
    low, high = F.min("_v"), F.max("_v")
    result = picked.groupBy(*keys, "share").agg((low + (high - low) * F.max("_fraction")).alias("value"))
    return result if by else result.drop("_all")


def percentile_columns(
    df: DataFrame, value: str, names: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """The same percentiles as one row per group, one named column each."""
    keys = list(by)
    long = exact_percentiles(df, value, sorted(set(names.values())), keys)
    wide = [
        F.max(F.when(F.col("share") == F.lit(float(share)), F.col("value"))).alias(name)
        for name, share in names.items()
    ]
    return long.groupBy(*keys).agg(*wide)
