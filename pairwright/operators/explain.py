"""Explanations of matches, all as columns of the match table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.scores import band_at_least, score_to_strength
from pairwright.operators.joins import similar_listed_skills
from pairwright.operators.skew import top_k

_NO_RELATED = "array<struct<similarity:double,skill1:string,skill2:string>>"


def related_skill_lists(
    matches: DataFrame, similarities: DataFrame, keep: int = 5,
    resume_skills: str = "resume_skills", job_skills: str = "job_skills",
) -> DataFrame:
    """``resume_id, job_id, related_skills``: the closest resume-only x job-only skills of matches with skill arrays."""
    keys = ["resume_id", "job_id"]
    listed = matches.select(*keys, resume_skills, job_skills).dropDuplicates(keys)
    near = similar_listed_skills(listed, keys, resume_skills, job_skills, similarities)
    best = top_k(near, keys, [F.desc("similarity"), F.asc("skill1"), F.asc("skill2")], keep, "_r")
    return best.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_r", "similarity", "skill1", "skill2"))).alias("_l")
    ).select(*keys, F.transform(
        "_l", lambda r: F.struct(r["similarity"].alias("similarity"), r["skill1"].alias("skill1"),
                                 r["skill2"].alias("skill2"))
    ).alias("related_skills"))


def explain_skills(matches: DataFrame, resume_skills: str = "resume_skills",
                   job_skills: str = "job_skills", related: str = "related_skills") -> DataFrame:
    """Adds ``skill_explanation`` from two skill arrays and the related list."""
    mine = F.coalesce(resume_skills, F.array().cast("array<string>"))
    wanted = F.coalesce(job_skills, F.array().cast("array<string>"))
    near = F.coalesce(related, F.array().cast(_NO_RELATED))
    matched = F.array_sort(F.array_intersect(mine, wanted))
    needed = F.size(F.array_distinct(wanted))
    bonus = F.aggregate(near, F.lit(0.0), lambda t, r: t + r["similarity"]) * 0.5 / needed
    score = F.when(needed > 0, F.least(F.lit(1.0), F.size(matched) / needed + bonus)).otherwise(
        F.when(F.size(mine) > 0, F.lit(1.0)).otherwise(F.lit(0.5))
    )
    return matches.withColumn("skill_explanation", F.struct(
        matched.alias("matched_skills"),
        F.array_sort(F.array_except(wanted, mine)).alias("missing_skills"),
        near.alias("related_skills"),
        F.slice(F.array_sort(F.array_except(mine, wanted)), 1, 5).alias("bonus_skills"),
        score.alias("match_score"), score_to_strength(score).alias("strength"),
    ))


def _level(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in fv.EXPERIENCE_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(name)), F.lit(fv.UNKNOWN_EXPERIENCE_RANK))


def explain_experience(
    matches: DataFrame, resume_level: str = "resume_level", resume_years: str = "resume_years",
    job_level: str = "job_level", job_years: str = "job_years",
) -> DataFrame:
    """Adds ``experience_explanation``; null when the job asks for neither level nor years."""
    asked_years = F.coalesce(F.col(job_years), F.lit(0)) != 0
    own_years = F.coalesce(F.col(resume_years), F.lit(0)) != 0
    asked_level = F.coalesce(F.nullif(F.col(job_level), F.lit("")), F.lit("unknown"))
    own_level = F.coalesce(F.nullif(F.col(resume_level), F.lit("")), F.lit("unknown"))
    gap = _level(own_level) - _level(asked_level)
    level_score = F.when(gap >= 0, 1.0).when(gap == -1, 0.7).otherwise(0.4)
    notes = (
        F.when(gap >= 0, fv.NOTE_LEVEL_MET)
        .when(gap == -1, fv.NOTE_LEVEL_NEAR)
        .otherwise(fv.NOTE_LEVEL_BELOW)
    )
    years_score = (
        F.when(F.col(resume_years) >= F.col(job_years), 1.0)
        .when(F.col(resume_years) >= F.col(job_years) * 0.7, 0.8).otherwise(0.5)
    )
    score = F.when(asked_years & own_years, (level_score + years_score) / 2).otherwise(level_score)
    part = F.struct(
        asked_level.alias("required_level"), own_level.alias("candidate_level"),
        F.col(job_years).alias("years_required"), F.col(resume_years).alias("years_candidate"),
        score.alias("match_score"), score_to_strength(score).alias("strength"), notes.alias("notes"),
    )
    named = F.coalesce(F.col(job_level), F.lit("")) != ""
    return matches.withColumn("experience_explanation", F.when(named | asked_years, part))


def _in_region(place: Column, cities: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for city in cities:
        hit = hit | F.lower(place).contains(city)
    return hit


def explain_location(
    matches: DataFrame, resume_location: str = "resume_location", job_location: str = "job_location",
    is_remote: str = "is_remote", regions: tuple = fv.REGIONS,
) -> DataFrame:
    """Adds ``location_explanation``; null when the job has no location."""
    own = F.coalesce(F.nullif(F.col(resume_location), F.lit("")), F.lit(fv.UNKNOWN_PLACE))
    job = F.col(job_location)
    remote = F.coalesce(F.col(is_remote), F.lit(False))
    same_region = F.lit(False)
    for _, cities in regions:
        same_region = same_region | (_in_region(own, cities) & _in_region(job, cities))
    exact = remote | (F.lower(own) == F.lower(job))
    part = F.struct(
        job.alias("job_location"), own.alias("candidate_location"), remote.alias("is_remote"),
        F.lit(None).cast("double").alias("distance_km"),
        F.when(exact, 1.0).when(same_region, 0.8).otherwise(0.3).alias("match_score"),
        F.when(exact, "strong").when(same_region, "moderate").otherwise("weak").alias("strength"),
    )
    return matches.withColumn(
        "location_explanation", F.when(F.coalesce(job, F.lit("")) != "", part)
    )


def explain_summary(matches: DataFrame, overall: str = "overall_score") -> DataFrame:
    """Adds ``overall_strength, summary, highlights, concerns`` from the three parts."""
    skill, exp, loc = (F.col(f"{p}_explanation") for p in ("skill", "experience", "location"))

    def first_three(items: Column) -> Column:
        return F.array_join(F.slice(items, 1, 3), ", ")

    def counted(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(
            F.lit(f"{label} "), F.size(items).cast("string"), F.lit(fv.REQUIRED_SKILLS),
            first_three(items),
        ))

    remote = F.coalesce(loc["is_remote"], F.lit(False))
    highlights = F.array_compact(F.array(
        counted(fv.LABEL_MATCHES, skill["matched_skills"]),
        F.when(F.size(skill["bonus_skills"]) > 0, F.concat(
            F.lit(fv.BRINGS_SKILLS), first_three(skill["bonus_skills"]))),
        F.when(exp["strength"] == "strong", F.concat(
            F.lit(fv.LEVEL_BEFORE), exp["candidate_level"], F.lit(fv.LEVEL_AFTER))),
        F.when(remote, F.lit(fv.REMOTE_AVAILABLE)).when(
            loc["strength"] == "strong", F.concat(F.lit(fv.LOCATION_MATCHES), loc["job_location"])),
    ))
    concerns = F.array_compact(F.array(
        counted(fv.LABEL_MISSING, skill["missing_skills"]),
        F.when(exp["strength"].isin("weak", "missing"), F.concat(
            F.lit(fv.LEVEL_CONCERN_BEFORE), exp["required_level"], F.lit(fv.LEVEL_CONCERN_AFTER))),
        F.when(~remote & (loc["strength"] == "weak"), F.concat(
            F.lit(fv.LOCATION_MISMATCH), loc["job_location"])),
    ))
    return matches.withColumns({
        "overall_strength": score_to_strength(F.col(overall)),
        "summary": band_at_least(F.col(overall), fv.SUMMARY_CUTS, fv.SUMMARY_OTHERWISE),
        "highlights": highlights,
        "concerns": concerns,
    })


def explain_batch(matches: DataFrame) -> DataFrame:
    """All parts for a match table that holds skill arrays and metadata columns."""
    return explain_summary(explain_location(explain_experience(explain_skills(matches))))
