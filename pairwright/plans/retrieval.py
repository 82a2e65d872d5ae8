"""Retrieve, enrich with skills, re-score, fuse and explain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators.explain import explain_batch, related_skill_lists
from pairwright.operators.ranking import PairScorer, fuse_scores, overlap_scorer, score_text_pairs
from pairwright.operators.skills import skill_graph_scores
from pairwright.operators.vectors import vector_topk_join
from pairwright.session import cut_lineage


def multi_stage_matches(
    resumes: DataFrame, jobs: DataFrame, resume_skills: DataFrame, job_skills: DataFrame | Callable[[DataFrame], DataFrame],
    scorer: PairScorer | None = overlap_scorer, retrieve: int = fv.RETRIEVE_ROWS,
    keep: int = fv.FINAL_ROWS,
) -> DataFrame:
    """Vector retrieval, skill overlap, pair scores on the retrieved rows, fused ranking.

    ``job_skills`` is a table of the jobs' skills, or gives it for the retrieved jobs (``job_id``), so that skills which take
    long to find are looked for in those alone.
    """
    near = vector_topk_join(
        resumes, jobs, retrieve, query_id="resume_id", item_id="job_id",
        query_vector="resume_vector", item_vector="job_vector", score="bi_score", similarity=True,
    ).drop("rank")
    if callable(job_skills):
        near = cut_lineage(near)
        job_skills = job_skills(near.select("job_id").distinct())
    skilled = near.join(
        resume_skills.select("resume_id", F.col("skills").alias("resume_skills")), "resume_id", "left"
    ).join(job_skills.select("job_id", F.col("skills").alias("job_skills")), "job_id", "left")
    empty = F.array().cast("array<string>")
    skilled = skilled.withColumns({
        c: F.coalesce(c, empty) for c in ("resume_skills", "job_skills")
    })
    scored = skill_graph_scores(skilled, "resume_skills", "job_skills")
    if scorer is None:
        scored = scored.withColumn("cross_score", F.lit(None).cast("double"))
    else:
        texts = scored.join(resumes.select("resume_id", F.col("text").alias("_rt")), "resume_id").join(
            jobs.select("job_id", F.col("text").alias("_jt")), "job_id"
        )
        scored = score_text_pairs(texts, "_rt", "_jt", scorer=scorer).drop("_rt", "_jt")
    return fuse_scores(scored, "resume_id", "job_id", retrieve, keep)


def explained_matches(
    matches: DataFrame, resume_meta: DataFrame, job_meta: DataFrame, similarities: DataFrame | None = None,
) -> DataFrame:
    """Fused matches with all explanation columns.

    ``resume_meta`` has ``resume_id, resume_level, resume_years, resume_location``; ``job_meta``
    has ``job_id, job_title, job_level, job_years, job_location, is_remote``.
    """
    rows = matches.withColumnRenamed("final_score", "overall_score").join(
        resume_meta, "resume_id", "left"
    ).join(job_meta, "job_id", "left")
    if similarities is None:
        rows = rows.withColumn(
            "related_skills",
            F.lit(None).cast("array<struct<similarity:double,skill1:string,skill2:string>>"),
        )
    else:
        rows = rows.join(related_skill_lists(matches, similarities), ["resume_id", "job_id"], "left")
    return explain_batch(rows)
