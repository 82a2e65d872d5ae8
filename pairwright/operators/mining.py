"""Hard negatives and training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators.aggregates import normalize_by_group_max
from pairwright.operators.joins import merge_candidates
from pairwright.operators.skew import top_k
from pairwright.operators.terms import bm25_search
from pairwright.operators.vectors import vector_topk_join


def mine_bm25_negatives(
    resumes: DataFrame, jobs: DataFrame, positives: DataFrame,
    k: int = fv.NEGATIVES_PER_SAMPLE * fv.CANDIDATE_MULTIPLIER,
    index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """``resume_id, job_id, bm25_score, rank``; positives never compete."""
    return bm25_search(
        resumes, jobs, k, query_id="resume_id", doc_id="job_id", query_text="text",
        doc_text="text", excluded=positives, index=index, stats=stats,
    )


def mine_embedding_negatives(
    resumes: DataFrame, jobs: DataFrame, positives: DataFrame,
    k: int = fv.NEGATIVES_PER_SAMPLE * fv.CANDIDATE_MULTIPLIER,
    band: tuple[float, float] = fv.SIMILARITY_BAND,
) -> DataFrame:
    """``resume_id, job_id, embedding_score, rank`` of jobs inside the similarity band."""
    return vector_topk_join(
        resumes.where(F.col("resume_vector").isNotNull()),
        jobs.where(F.col("job_vector").isNotNull()), k,
        query_id="resume_id", item_id="job_id", query_vector="resume_vector",
        item_vector="job_vector", score="embedding_score", excluded=positives, band=band,
        similarity=True,
    )


def combine_candidates(bm25: DataFrame, embedding: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """Merged candidates with the weighted sum of scores scaled by each query's maximum."""
    merged = merge_candidates(bm25, embedding, query_id, item_id)
    scaled = normalize_by_group_max(merged, [query_id], "bm25_score", "_bm25")
    scaled = normalize_by_group_max(scaled, [query_id], "embedding_score", "_emb")
    weighted = fv.BM25_SHARE * F.col("_bm25") + fv.EMBEDDING_SHARE * F.col("_emb")
    return scaled.withColumn(
        "combined_score",
        F.when(F.col("embedding_score") > 0, weighted).otherwise(F.col("_bm25")),
    ).drop("_bm25", "_emb")


def mine_combined_negatives(
    resumes: DataFrame, jobs: DataFrame, positives: DataFrame,
    k: int = fv.NEGATIVES_PER_SAMPLE, band: tuple[float, float] = fv.SIMILARITY_BAND,
    index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """Best k of both kinds of candidates, 2k of each kind merged."""
    bm25 = mine_bm25_negatives(resumes, jobs, positives, 2 * k, index, stats)
    embedding = mine_embedding_negatives(resumes, jobs, positives, 2 * k, band)
    combined = combine_candidates(bm25, embedding, "resume_id", "job_id")
    rounded = combined.withColumn("combined_score", F.round("combined_score", 9))
    return top_k(rounded, ["resume_id"], [F.desc("combined_score"), F.asc("job_id")], k)


def _active_resumes(resumes: DataFrame, applications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resumes with text, vector and an application, and their (resume_id, job_id)."""
    usable = resumes.where(
        F.col("user_id").isNotNull() & F.col("resume_vector").isNotNull()
        & (F.coalesce("text", F.lit("")) != "")
    )
    applied = applications.select("user_id", "job_id").distinct()
    active = usable.join(applied.select("user_id"), "user_id", "left_semi")
    return active, active.select("resume_id", "user_id").join(applied, "user_id").select("resume_id", "job_id")


def training_pairs(resumes: DataFrame, jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """``resume_id, job_id`` of every sample of ``build_training_dataset``, which gives one row for each.

    Negatives add columns to a sample and never a row, so a count of samples needs none mined.
    """
    active, positives = _active_resumes(resumes, applications)
    with_text = jobs.where(F.coalesce("text", F.lit("")) != "").select("job_id")
    return positives.join(with_text, "job_id").join(active.select("resume_id"), "resume_id")


def build_training_dataset(
    resumes: DataFrame, jobs: DataFrame, applications: DataFrame,
    k: int = fv.NEGATIVES_PER_SAMPLE, band: tuple[float, float] = fv.SIMILARITY_BAND,
    source: str = "application", index: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """One sample per (resume, application to a job with text).

    Negatives depend on the user's whole application set only, so they are mined once per
    resume and joined to all its samples. Needs ``resume_id, user_id, text, resume_vector``,
    ``job_id, text, job_vector`` and ``user_id, job_id``.
    """
    active, positives = _active_resumes(resumes, applications)
    texts = jobs.where(F.coalesce("text", F.lit("")) != "")
    mined = mine_combined_negatives(active, texts, positives, k, band, index, stats)
    negatives = (
        mined.join(texts.select("job_id", F.col("text").alias("_t"), F.col("job_vector").alias("_v")), "job_id")
        .groupBy("resume_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "rank", F.col("job_id").cast("string").alias("id"), "_t", "_v"
        ))).alias("_n"))
        .select(
            "resume_id",
            F.transform("_n", lambda n: n["id"]).alias("hard_negative_job_ids"),
            F.transform("_n", lambda n: n["_t"]).alias("hard_negative_job_texts"),
            F.transform("_n", lambda n: n["_v"]).alias("hard_negative_job_embeddings"),
        )
    )
    positive_jobs = texts.select(
        "job_id", F.col("text").alias("positive_job_text"),
        F.col("job_vector").alias("positive_job_embedding"),
    )
    samples = positives.join(positive_jobs, "job_id").join(
        active.select("resume_id", F.col("text").alias("resume_text"),
                      F.col("resume_vector").alias("resume_embedding")), "resume_id"
    ).join(negatives, "resume_id", "left")
    resume, job = F.col("resume_id").cast("string"), F.col("job_id").cast("string")
    return samples.select(
        F.sha2(F.concat_ws("|", resume, job), 256).alias("sample_id"), resume.alias("resume_id"),
        "resume_text", "resume_embedding", job.alias("positive_job_id"), "positive_job_text",
        "positive_job_embedding",
        F.coalesce("hard_negative_job_ids", F.array().cast("array<string>")).alias("hard_negative_job_ids"),
        F.coalesce("hard_negative_job_texts", F.array().cast("array<string>")).alias("hard_negative_job_texts"),
        F.coalesce(
            "hard_negative_job_embeddings",
            F.array().cast(negatives.schema["hard_negative_job_embeddings"].dataType),
        ).alias("hard_negative_job_embeddings"),
        F.lit(source).alias("source"), F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit("combined").alias("mining_strategy"),
    )


def enough_samples(samples: DataFrame, needed: int = fv.MIN_SAMPLES) -> DataFrame:
    """``samples, needed, enough``: whether a data set is large enough to train on."""
    return samples.agg(F.count(F.lit(1)).alias("samples")).select(
        "samples", F.lit(needed).alias("needed"), (F.col("samples") >= needed).alias("enough")
    )
