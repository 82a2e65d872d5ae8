"""Sorting, windows of results, pages and fill-up."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators.joins import union_dedup_by_id
from pairwright.operators.skew import bucket_of, positions_by_bucket, top_k, value_bounds

SORT_TYPES = ("recommended", "date", "matching_score")


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def _age_micros(posted: Column, as_of: Column) -> Column:
    known = F.coalesce(posted.cast("timestamp"), F.lit(fv.UNKNOWN_POSTED_DATE).cast("timestamp"))
    return _micros(as_of) - F.unix_micros(known)


def score_threshold(fields: Column) -> Column:
    """50, or 0 when the request filters by field."""
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.lit(0.0)).otherwise(F.lit(50.0))


def date_key(score: Column, posted: Column, as_of: Column, threshold: Column) -> Column:
    """Newer first; weak matches count as 90 days old. Higher keys come first."""
    age = _age_micros(posted, as_of) / 1_000_000.0
    strong = score.isNull() | (score >= threshold)
    return F.when(strong, -age).otherwise(score - 3600.0 * 24 * 90)


def _growth(days: pd.Series) -> pd.Series:
    def power(day: float) -> float:
        try:
            return math.pow(1.03, day)
        except OverflowError:
            return math.inf

    known = days.dropna().unique()
    return days.map(dict(zip(known, map(power, known), strict=True))).astype("float64")


def age_growth(days: Column) -> Column:
    """1.03 to the power of ``days``, as the C library rounds it.

    Spark's own power may be off in the last place, which parts equal keys and swaps rows among them.
    """
    return F.pandas_udf(_growth, "double")(days.cast("double"))


def posted_growth(posted: Column, as_of: Column) -> Column:
    """The growth of the penalty since a job was posted."""
    return age_growth(F.floor(_age_micros(posted, as_of) / 86_400_000_000.0))


def recommended_key(score: Column, posted: Column, as_of: Column, threshold: Column, growth: Column | None = None) -> Column:
    """Score with an exponential age penalty; weak matches go far down. ``growth`` is ``posted_growth`` if known already."""
    value = F.coalesce(score, F.lit(0.0))
    grown = posted_growth(posted, as_of) if growth is None else growth
    return F.when(value < threshold, value - 1440.0).otherwise(value + 100.0 * (1.0 - grown))


def score_key(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0))


def sort_key(sort_type: Column, score: Column, posted: Column, as_of: Column,
             threshold: Column, growth: Column | None = None) -> Column:
    """The key of the request's sort type; an unknown type means recommended."""
    return (
        F.when(sort_type == "date", date_key(score, posted, as_of, threshold))
        .when(sort_type == "matching_score", score_key(score))
        .otherwise(recommended_key(score, posted, as_of, threshold, growth))
    )


def sort_within(df: DataFrame, key: Column, keys: Sequence[str] = ("request_id",),
                prior: str = "rank", item_id: str = "job_id", name: str = "position") -> DataFrame:
    """Positions by falling key; equal keys keep their prior order.

    Meant for result windows, which hold at most two times ``WINDOW_ROWS`` rows per request.
    """
    window = Window.partitionBy(*keys).orderBy(key.desc(), F.col(prior).asc(), F.col(item_id).asc())
    return df.withColumn(name, F.row_number().over(window))


def sort_all(df: DataFrame, key: Column, prior: str, buckets: int = 32,
             name: str = "position") -> DataFrame:
    """Positions over a whole table without one big sort task."""
    keyed = df.withColumn("_key", -key)
    bounds = value_bounds(keyed, "_key", buckets)
    placed = keyed.withColumn("_b", bucket_of(F.col("_key"), bounds))
    return positions_by_bucket(placed, "_b", [F.col("_key"), F.col(prior)], name).drop("_key", "_b")


def search_by_date(jobs: DataFrame, limit: int, offset: int = 0, posted: str = "posted_date",
                   job_id: str = "job_id") -> DataFrame:
    """Guest search: newest first, unknown dates before all, one slice."""
    return jobs.orderBy(F.col(posted).desc_nulls_first(), F.col(job_id).asc()).offset(offset).limit(limit)


def effective_offset(offset: Column) -> Column:
    """Offsets beyond the last page fall back to the first window."""
    return F.when(offset > fv.MAX_OFFSET, F.lit(0)).otherwise(offset)


def page_windows(offset: Column) -> Column:
    """Result windows (of 1000 ranks) a page needs: one, or two when it straddles."""
    first = F.floor(effective_offset(offset) / fv.WINDOW_ROWS)
    second = F.floor(effective_offset(offset + fv.WINDOW_ROWS) / fv.WINDOW_ROWS)
    straddles = offset % fv.WINDOW_ROWS > (offset + fv.PAGE_ROWS) % fv.WINDOW_ROWS
    return F.when(straddles, F.array_distinct(F.array(first, second))).otherwise(F.array(first))


def page_start(offset: Column) -> Column:
    """Slice start inside the loaded windows; it follows the asked offset."""
    return offset % fv.WINDOW_ROWS


def in_windows(ranked: DataFrame, requests: DataFrame, request_id: str = "request_id",
               rank: str = "rank") -> DataFrame:
    """Ranked matches that lie in the windows their request's page needs."""
    wanted = requests.select(request_id, "offset", F.explode(page_windows(F.col("offset"))).alias("_window"))
    placed = ranked.withColumn("_window", F.floor((F.col(rank) - 1) / fv.WINDOW_ROWS))
    return placed.join(wanted, [request_id, "_window"]).drop("_window")


def cut_page(sorted_matches: DataFrame, position: str = "position") -> DataFrame:
    """The page's rows of a sorted window; needs the ``offset`` column."""
    start = page_start(F.col("offset"))
    return sorted_matches.where(
        (F.col(position) > start) & (F.col(position) <= start + fv.PAGE_ROWS)
    )


def page_window(ranked: DataFrame, requests: DataFrame, key: Column,
                request_id: str = "request_id") -> DataFrame:
    """Pages of every request: window by rank, sorted inside the window, sliced."""
    return cut_page(sort_within(in_windows(ranked, requests, request_id), key, [request_id]))


def fallback_fill(
    filtered: DataFrame, unfiltered: DataFrame, requests: DataFrame, key: Column,
    request_id: str = "request_id", job_id: str = "job_id",
) -> DataFrame:
    """Short first-window results continued by unfiltered matches the request lacks.

    ``filtered`` holds the loaded windows, ``unfiltered`` the first window without filters;
    both carry ``rank`` and what ``key`` reads. Adds ``tier``, ``position`` and
    ``total_count``; filled requests report 1000, others 2000.
    """
    counts = filtered.groupBy(request_id).agg(F.count(F.lit(1)).alias("_n"))
    need = requests.select(request_id, "offset").join(counts, request_id, "left").withColumn(
        "_fill",
        (F.coalesce("_n", F.lit(0)) < fv.WINDOW_ROWS) & (F.col("offset") < fv.WINDOW_ROWS),
    ).drop("_n")
    spare = unfiltered.where(F.col("rank") <= fv.WINDOW_ROWS).join(
        need.where("_fill").select(request_id), request_id, "left_semi"
    )
    both = union_dedup_by_id(filtered, spare, [request_id, job_id]).withColumn("_key", key)
    window = Window.partitionBy(request_id).orderBy(
        F.asc("tier"), F.desc("_key"), F.asc("rank"), F.asc(job_id)
    )
    return (
        both.withColumn("position", F.row_number().over(window)).drop("_key")
        .join(need, request_id)
        .withColumn("total_count", F.when(F.col("_fill"), fv.FILLED_TOTAL).otherwise(fv.CONSTANT_TOTAL))
        .drop("_fill")
    )


def topk_per_query(df: DataFrame, k: int, score: str, query_id: str = "query_id",
                   item_id: str = "item_id", name: str = "rank") -> DataFrame:
    return top_k(df, [query_id], [F.col(score).desc(), F.col(item_id).asc()], k, name)


def assign_rank(df: DataFrame, score: str = "final_score", query_id: str = "query_id",
                item_id: str = "item_id", keep: int = fv.FINAL_ROWS) -> DataFrame:
    """Final ranks 1..keep by falling score."""
    return topk_per_query(df, keep, score, query_id, item_id)


def top_matches_internal(pages: DataFrame, amount: int | None = None) -> DataFrame:
    """The first ``amount`` (default 10) rows of recommended pages at offset 0."""
    return pages.where(F.col("position") <= (amount or 10))


def rejection_list(rejected: DataFrame, user_id: str = "user_id", job_id: str = "job_id",
                   time: str = "timestamp") -> DataFrame:
    """Rejections per user, newest first."""
    return rejected.select(user_id, job_id, time).orderBy(F.asc(user_id), F.desc(time), F.asc(job_id))
