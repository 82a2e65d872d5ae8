"""Roll-ups of scores, fields, metrics and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.scores import score_linear_percentage, score_to_percentage
from pairwright.operators.quantiles import exact_percentiles, percentile_columns
from pairwright.operators.skew import bucket_of, positions_by_bucket, running_sum_by_rank, value_bounds


def fold_job_fields(matches: DataFrame, bridge: DataFrame, fields: DataFrame,
                    job_id: str = "job_id", field_id: str = "field_id") -> DataFrame:
    """Matches with the sorted sets of their root and sub fields.

    Fields are folded once per surviving job, so wide match rows are not multiplied.
    """
    survivors = bridge.join(matches.select(job_id), job_id, "left_semi")
    folded = (
        survivors.join(fields, field_id)
        .groupBy(job_id)
        .agg(
            F.array_sort(F.collect_set("root_field")).alias("root_fields"),
            F.array_sort(F.collect_set("sub_field")).alias("sub_fields"),
        )
    )
    return matches.join(folded, job_id, "left")


def fields_catalog(fields: DataFrame, root: str = "root_field", sub: str = "sub_field",
                   field_id: str = "field_id") -> DataFrame:
    """Distinct fields with their position below their root field, in id order.

    One row per field instead of one list per root, so no root's list has to fit a task.
    """
    rows = fields.select(root, sub, field_id).distinct()
    bounds = value_bounds(rows, field_id, 16)
    return positions_by_bucket(
        rows.withColumn("_b", bucket_of(F.col(field_id), bounds)), "_b", [F.col(field_id)],
        keys=[root],
    ).drop("_b")


def score_distribution(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Count, extremes, mean, median and sample deviation per tag; the last two need n > 1."""
    base = df.groupBy(*by).agg(
        F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("stdev"),
    )
    middle = percentile_columns(df, score, {"median": 0.5}, by)
    many = F.col("n") > 1
    return base.join(middle, list(by), "left").withColumn("median", F.when(many, F.col("median"))).withColumn(
        "stdev", F.when(many, F.col("stdev"))
    )


def score_percentiles(df: DataFrame, score: str, shares: Sequence[float] = fv.SCORE_PERCENTILES,
                      by: Sequence[str] = ()) -> DataFrame:
    """Population summary and percentile columns ``p10 ... p99``."""
    names = {f"p{round(share * 100)}": share for share in shares}
    keys = list(by) or ["_one"]
    source = df if by else df.withColumn("_one", F.lit(1))
    base = source.groupBy(*keys).agg(
        F.count(score).alias("n"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
    )
    cuts = percentile_columns(source, score, {**names, "median": 0.5}, keys)
    joined = base.join(cuts, keys)
    return joined if by else joined.drop("_one")


def score_threshold_share(df: DataFrame, distance: str) -> DataFrame:
    """Percent of rows above 80, 60 and 0 for both calibrations: ``mapping, above_*``."""
    both = df.select(F.explode(F.array(
        F.struct(F.lit("linear").alias("mapping"), score_linear_percentage(F.col(distance)).alias("p")),
        F.struct(F.lit("sigmoid").alias("mapping"), score_to_percentage(F.col(distance)).alias("p")),
    )).alias("_r")).select("_r.*")
    return both.groupBy("mapping").agg(*[
        (F.avg(F.when(F.col("p") > cut, 1.0).otherwise(0.0)) * 100).alias(f"above_{cut}")
        for cut in (80, 60, 0)
    ])


def score_transform_compare(df: DataFrame, distance: str) -> DataFrame:
    """Raw distance beside both calibrations, at fixed points and at the data's percentiles.

    At a percentile the calibrated values belong to the first score not below it.
    """
    spark = df.sparkSession
    shown = lambda raw: [
        score_linear_percentage(raw).alias("linear"), score_to_percentage(raw).alias("sigmoid")
    ]
    fixed = spark.createDataFrame([(float(p),) for p in fv.COMPARE_POINTS], "raw double").select(
        F.lit("fixed").alias("kind"), F.col("raw").alias("point"), "raw", *shown(F.col("raw"))
    )
    cuts = exact_percentiles(df, distance, fv.COMPARE_PERCENTILES).withColumn("_one", F.lit(1))
    # five cut rows against the scores: keep, per cut, the smallest score at or above it
    marks = cuts.select(F.collect_list(F.struct("share", "value")).alias("m")).scalar()
    reached = df.select(F.col(distance).cast("double").alias("_d"), F.explode(marks).alias("_m")).where(
        F.col("_d") >= F.col("_m.value")
    ).groupBy(F.col("_m.share").alias("point"), F.col("_m.value").alias("raw")).agg(F.min("_d").alias("_at"))
    at = reached.select(F.lit("percentile").alias("kind"), "point", "raw", *shown(F.col("_at")))
    return fixed.unionByName(at)


def score_histogram(df: DataFrame, score: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over the value range: ``bin, count, density``; the last is closed."""
    span = df.agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"),
                  F.count(score).alias("n"))
    lo, hi, n = (span.select(c).scalar() for c in ("lo", "hi", "n"))
    index = F.least(F.floor((F.col(score) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = df.where(F.col(score).isNotNull()).groupBy(
        F.when(hi > lo, index).otherwise(F.lit(0)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("count"))
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0 / bins))
    return counts.withColumn("density", F.col("count") / (n * width))


def score_gaussian_fit(df: DataFrame, score: str) -> DataFrame:
    """Maximum-likelihood mean and deviation."""
    return df.agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sigma"))


def dataset_statistics(samples: DataFrame, split: str | None = None) -> DataFrame:
    """``kind, name, count, avg_hard_negatives``: whole set, per source, strategy and split."""
    kinds = ["source", "mining_strategy"] + ([split] if split else [])
    sized = samples.select(*kinds, F.coalesce(F.size("hard_negative_job_ids"), F.lit(0)).alias("_negatives"))
    sets = ", ".join(["()"] + [f"({kind})" for kind in kinds])
    columns = [F.col(kind) for kind in kinds]
    counted = sized.groupingSets([[], *[[c] for c in columns]], *columns).agg(
        *[F.grouping(kind).alias(f"_{kind}") for kind in kinds],
        F.count(F.lit(1)).alias("count"), F.avg("_negatives").alias("avg_hard_negatives"),
    )
    kind, name = F.lit("all"), F.lit("all")
    for k in kinds:
        kind = F.when(F.col(f"_{k}") == 0, F.lit(k)).otherwise(kind)
        name = F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(name)
    return counted.select(kind.alias("kind"), name.alias("name"), "count", "avg_hard_negatives")


def miner_statistics(jobs: DataFrame, text: str = "text", vector: str = "embedding") -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count(F.when(F.coalesce(F.col(text), F.lit("")) != "", 1)).alias("texts"),
        F.count(vector).alias("embeddings"),
    )


def skill_vector(skills: DataFrame, doc_id: str = "doc_id", skill: str = "skill",
                 confidence: str = "confidence") -> DataFrame:
    """Highest confidence per (document, skill) as one map per document."""
    best = skills.groupBy(doc_id, skill).agg(F.max(confidence).alias("_c"))
    return best.groupBy(doc_id).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(skill, "_c")))).alias("skill_vector")
    )


def algorithm_usage(events: DataFrame, path: str = "path", reason: str = "reason") -> DataFrame:
    return events.groupBy(path, reason).agg(F.count(F.lit(1)).alias("uses"))


def match_counts(matches: DataFrame, request_id: str = "request_id") -> DataFrame:
    return matches.groupBy(request_id).agg(F.count(F.lit(1)).alias("matches"))


def latency_summary(events: DataFrame, latency: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, p95 and p99 of a latency column."""
    keys = list(by) or ["_one"]
    source = events if by else events.withColumn("_one", F.lit(1))
    cuts = percentile_columns(source, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys)
    joined = source.groupBy(*keys).agg(F.avg(latency).alias("mean")).join(cuts, keys)
    return joined if by else joined.drop("_one")


def cache_hit_rate(events: DataFrame, operation: str = "operation", outcome: str = "outcome",
                   latency: str = "latency_ms") -> DataFrame:
    """Hits, misses, errors, hit rate and mean latency per operation."""
    def times(value: str) -> Column:
        return F.sum(F.when(F.col(outcome) == value, 1).otherwise(0))

    looked_up = times("hit") + times("miss")
    return events.groupBy(operation).agg(
        times("hit").alias("hits"), times("miss").alias("misses"), times("error").alias("errors"),
        F.when(looked_up > 0, times("hit") / looked_up).alias("hit_rate"),
        F.avg(latency).alias("mean_latency"),
    )


def empirical_cdf(df: DataFrame, value: str, buckets: int = 32) -> DataFrame:
    """``value, count, cdf``: share of rows at or below each distinct value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("count"))
    bounds = value_bounds(counted, value, buckets)
    placed = counted.withColumn("_b", bucket_of(F.col(value), bounds))
    ranked = positions_by_bucket(placed, "_b", [F.col(value)], "_rank")
    summed = running_sum_by_rank(ranked.withColumn("_all", F.lit(0)), ["_all"], "_rank", F.col("count"), "_below")
    total = df.agg(F.count(value).alias("n")).scalar()
    return summed.select(value, "count", (F.col("_below") / total).alias("cdf"))


def normalize_by_group_max(df: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """Score divided by the highest score of its group; an all-zero group divides by 1.

    The maximum is aggregated first and joined back, so a hot group is never one task.
    """
    top = df.groupBy(*keys).agg(F.max(score).alias("_max"))
    divisor = F.when(F.col("_max") == 0, F.lit(1.0)).otherwise(F.col("_max"))
    return df.join(top, list(keys)).withColumn(name, F.col(score) / divisor).drop("_max")
