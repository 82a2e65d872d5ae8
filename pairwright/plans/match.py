"""Matching every user with every job: filter, exclude, search, calibrate, sort, page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.scores import score_to_percentage
from pairwright.operators.aggregates import fold_job_fields
from pairwright.operators.filters import FILTER_COLUMNS, eligible_pairs, filter_signature
from pairwright.operators.joins import exclusion_union
from pairwright.operators.paging import (
    cut_page, fallback_fill, page_start, page_windows, posted_growth, score_threshold, sort_key, sort_within,
)
from pairwright.operators.skew import top_k
from pairwright.operators.vectors import vector_topk_join
from pairwright.session import cut_lineage


def excluded_pairs(requests: DataFrame, applied: DataFrame, rejected: DataFrame,
                   cooled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user, job) pairs that must not compete, of users who ask, and jobs cooled down for everybody.

    Pairs stay those of the user: for all requests of a user they would be as many as the requests times the pairs.
    """
    whole = cut_lineage(exclusion_union(applied, rejected, cooled))
    personal = whole.where(F.col("user_id").isNotNull()).join(requests.select("user_id"), "user_id", "left_semi")
    return personal, whole.where(F.col("user_id").isNull()).select("job_id")


def ranked_matches(
    requests: DataFrame, jobs: DataFrame, applied: DataFrame, rejected: DataFrame,
    cooled: DataFrame, bridge: DataFrame | None = None, k: int | str = 3 * fv.WINDOW_ROWS,
    filtered: bool = True, carry: Sequence[str] = (),
) -> DataFrame:
    """``request_id, job_id, distance, score, rank`` and the ``carry`` columns of the jobs: nearest eligible jobs per request.

    ``k`` is a number or a column of ``requests`` with each request's own number.
    Filters and exclusions act before the cut to k. Requests with equal filters form one
    segment, whose eligible jobs are looked up once and searched block by block.
    """
    searchable = jobs.where(F.col("job_vector").isNotNull())
    pairs, cold = excluded_pairs(requests, applied, rejected, cooled)
    live = searchable.join(cold, "job_id", "left_anti")
    asking = requests.where(F.col("request_vector").isNotNull())
    search = dict(query_id="request_id", item_id="job_id", query_vector="request_vector",
                  item_vector="job_vector", excluded=pairs, excluded_by="user_id", carry=carry)
    if filtered:
        signed = asking.withColumn("signature", filter_signature())
        # every found row carries its segment, so that is a short number and not the long signature
        forms = cut_lineage(signed.groupBy("signature").agg(
            F.first(F.struct(*FILTER_COLUMNS), ignorenulls=False).alias("_f")
        ).select("signature", F.monotonically_increasing_id().alias("_form"), "_f.*"))
        signed = signed.join(forms.select("signature", "_form"), "signature").drop("signature").withColumnRenamed("_form", "signature")
        forms = forms.drop("signature").withColumnRenamed("_form", "signature")
        members = eligible_pairs(
            forms, live, bridge, keep=("job_vector", *carry), request_id="signature"
        )
        found = vector_topk_join(signed, members, k, segment="signature", **search).drop("signature", "_seg")
    else:
        found = vector_topk_join(asking, live, k, **search)
    return found.withColumn("score", score_to_percentage(F.col("distance")))


def search_by_date_requests(
    requests: DataFrame, jobs: DataFrame, applied: DataFrame, rejected: DataFrame, cooled: DataFrame,
    bridge: DataFrame | None = None, page_rows: int = fv.PAGE_ROWS,
) -> DataFrame:
    """``request_id, job_id, posted_date, rank``: the page of every request by date, for requests without a vector.

    The request's filters and exclusions act first; then jobs are newest first, unknown dates before all,
    ties by id, and the page holds the ranks offset + 1 to offset + ``page_rows``. Requests with equal filters share
    their newest jobs, of which only as many are kept as their deepest page and their exclusions can use.
    """
    pairs, cold = excluded_pairs(requests, applied, rejected, cooled)
    lost = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_lost"))
    signed = requests.withColumn("signature", filter_signature()).join(lost, "user_id", "left").withColumn(
        "_need", F.col("offset") + page_rows + F.coalesce("_lost", F.lit(0)))
    deepest = signed.agg(F.max("_need")).first()[0] or 0
    forms = signed.groupBy("signature").agg(
        F.first(F.struct(*FILTER_COLUMNS), ignorenulls=False).alias("_f")).select("signature", "_f.*")
    depth = signed.groupBy("signature").agg(F.max("_need").alias("_depth"))
    live = jobs.join(cold, "job_id", "left_anti")
    newest = [F.col("posted_date").desc_nulls_first(), F.col("job_id").asc()]
    members = top_k(
        eligible_pairs(forms, live, bridge, keep=("posted_date",), request_id="signature"), ["signature"], newest,
        int(deepest), "_at").join(depth, "signature").where(F.col("_at") <= F.col("_depth")).drop("_depth")
    asked = signed.select("request_id", "user_id", "signature", "offset", "_need")
    own = members.join(asked, "signature").where(F.col("_at") <= F.col("_need")).join(
        pairs, ["user_id", "job_id"], "left_anti")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("_at")))
    return ranked.where((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + page_rows)).select(
        "request_id", "job_id", "posted_date", "rank")


def ranks_needed(offset: Column) -> Column:
    """The deepest rank that the page at an offset can show."""
    return ((F.array_max(page_windows(offset)) + 1) * fv.WINDOW_ROWS).cast("int")


def short_requests(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Requests whose windows (``request_id, _n`` rows) end before their page and may be filled, so only they search unfiltered."""
    least = F.least(F.lit(fv.WINDOW_ROWS), page_start(F.col("offset")) + fv.PAGE_ROWS)
    return requests.where(F.col("offset") < fv.WINDOW_ROWS).join(counts, "request_id", "left").where(
        F.coalesce("_n", F.lit(0)) < least).drop("_n")


def match_user_jobs(
    requests: DataFrame, jobs: DataFrame, applied: DataFrame, rejected: DataFrame,
    cooled: DataFrame, as_of: Column, bridge: DataFrame | None = None,
    fields: DataFrame | None = None, fallback: bool = True,
) -> DataFrame:
    """The page each request asks for.

    Requests hold ``request_id, user_id, request_vector``, the filter columns, ``sort_type``
    and ``offset``; jobs hold ``job_id, job_vector, posted_date`` and what the filters read.
    Returns ``request_id, position, job_id, distance, score, rank, tier, total_count`` and the
    field sets when a field table is given. Requests without a vector get their filtered page by date,
    without distance and score.
    """
    every = requests
    requests = every.where(F.col("request_vector").isNotNull())
    # the key's only Python step runs once a job: after the search it would run once a found row and part the rows again
    jobs = cut_lineage(jobs.withColumn("_growth", posted_growth(F.col("posted_date"), as_of)))
    asked = requests.select(
        "request_id", "sort_type", "offset", score_threshold(F.col("fields")).alias("_threshold"),
        page_windows(F.col("offset")).alias("_windows"))
    key = sort_key(F.col("sort_type"), F.col("score"), F.col("posted_date"), as_of, F.col("_threshold"), F.col("_growth"))
    search = dict(jobs=jobs, applied=applied, rejected=rejected, cooled=cooled, carry=("posted_date", "_growth"))

    ranked = ranked_matches(requests.withColumn("_ranks", ranks_needed(F.col("offset"))), bridge=bridge, k="_ranks", **search)
    windows = ranked.join(asked, "request_id").where(
        F.array_contains("_windows", F.floor((F.col("rank") - 1) / fv.WINDOW_ROWS))).drop("_windows")
    placed = sort_within(windows, key).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("request_id")))
    # found rows come before filled ones, so a page that they cover is cut at once; all rows are kept of shorter requests
    start = page_start(F.col("offset"))
    kept = cut_lineage(placed.where(F.col("position").between(start + 1, start + fv.PAGE_ROWS) | (F.col("_n") < start + fv.PAGE_ROWS)))
    counts = kept.groupBy("request_id").agg(F.first("_n").alias("_n"))
    fills = (F.col("_n") < fv.WINDOW_ROWS) & (F.col("offset") < fv.WINDOW_ROWS)
    filled = kept.withColumn("tier", F.lit(0)).withColumn(
        "total_count", F.when(fills, fv.FILLED_TOTAL).otherwise(fv.CONSTANT_TOTAL) if fallback else F.lit(fv.CONSTANT_TOTAL))
    short = cut_lineage(short_requests(requests, counts)) if fallback else None
    if fallback and not short.isEmpty():
        spare = ranked_matches(short, k=fv.WINDOW_ROWS, filtered=False, **search).join(asked.drop("_windows"), "request_id")
        own = kept.join(short.select("request_id"), "request_id", "left_semi").drop("position", "_n", "offset")
        filled = filled.drop("_n").join(short.select("request_id"), "request_id", "left_anti").unionByName(
            fallback_fill(own, spare.drop("offset"), short, key), allowMissingColumns=True)
    page = cut_page(filled).select(
        "request_id", "position", "job_id", "distance", "score", "rank", "tier", "total_count"
    )
    guests = every.where(F.col("request_vector").isNull())
    if not guests.isEmpty():
        dated = search_by_date_requests(guests, jobs, applied, rejected, cooled, bridge)
        page = page.unionByName(dated.select(
            "request_id", F.col("rank").alias("position"), "job_id", F.lit(None).cast("double").alias("distance"),
            F.lit(None).cast("double").alias("score"), "rank", F.lit(0).alias("tier"),
            F.lit(fv.CONSTANT_TOTAL).alias("total_count")))
    return page if fields is None else fold_job_fields(page, bridge, fields)
