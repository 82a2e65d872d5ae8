"""Star joins, exclusions and id checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.text import uuid_valid
from pairwright.operators.bitmaps import likely_pairs, pair_map
from pairwright.operators.skew import top_k
from pairwright.session import cut_lineage


def join_star_left(
    jobs: DataFrame, companies: DataFrame, locations: DataFrame, countries: DataFrame
) -> DataFrame:
    """Jobs with company, location and country columns; unmatched keys stay as nulls.

    The location and country tables hold one row per city and country; which side is
    broadcast is left to the adaptive planner's size check.
    """
    return (
        jobs.join(companies, "company_id", "left")
        .join(locations, "location_id", "left")
        .join(countries, "country_id", "left")
    )


def join_semi_fields(jobs: DataFrame, bridge: DataFrame, wanted: DataFrame,
                     job_id: str = "job_id", field_id: str = "field_id") -> DataFrame:
    """Jobs with at least one field of the ``wanted`` table."""
    return jobs.join(bridge.join(wanted.select(field_id), field_id, "left_semi").select(job_id),
                     job_id, "left_semi")


def join_anti_blacklist(
    pairs: DataFrame, applied: DataFrame, cooled: DataFrame,
    user_id: str = "user_id", job_id: str = "job_id",
) -> DataFrame:
    """Drop pairs the user applied to, and jobs that are cooled down for everybody."""
    return pairs.join(applied.select(user_id, job_id), [user_id, job_id], "left_anti").join(
        cooled.select(job_id), job_id, "left_anti"
    )


def join_anti_rejected(pairs: DataFrame, rejected: DataFrame,
                       user_id: str = "user_id", job_id: str = "job_id") -> DataFrame:
    return pairs.join(rejected.select(user_id, job_id), [user_id, job_id], "left_anti")


def join_fields_fanout(matches: DataFrame, bridge: DataFrame, fields: DataFrame,
                       job_id: str = "job_id", field_id: str = "field_id") -> DataFrame:
    """One row per (already limited) match and field; matches without fields stay."""
    return matches.join(bridge, job_id, "left").join(fields, field_id, "left")


def merge_candidates(bm25: DataFrame, embedding: DataFrame, query_id: str = "query_id",
                     item_id: str = "item_id") -> DataFrame:
    """Full outer merge of two candidate lists; a missing score is 0."""
    merged = bm25.select(query_id, item_id, "bm25_score").join(
        embedding.select(query_id, item_id, "embedding_score"), [query_id, item_id], "full"
    )
    return merged.fillna(0.0, ["bm25_score", "embedding_score"])


def is_job_applied(pairs: DataFrame, applied: DataFrame,
                   user_id: str = "user_id", job_id: str = "job_id") -> DataFrame:
    """Flag per asked (user, job) pair."""
    return _flag(pairs, applied, [user_id, job_id], "is_applied")


def rejection_status(pairs: DataFrame, rejected: DataFrame,
                     user_id: str = "user_id", job_id: str = "job_id") -> DataFrame:
    return _flag(pairs, rejected, [user_id, job_id], "is_rejected")


def _flag(pairs: DataFrame, known: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    marked = known.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return pairs.join(marked, list(keys), "left").withColumn(
        name, F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def validate_job_ids(asked: DataFrame, jobs: DataFrame, asked_id: str = "asked_id",
                     position: str = "position", job_id: str = "job_id") -> DataFrame:
    """Asked ids without a job: malformed ones first, then unknown ones, in asked order.

    Stored ids are lower case and compared as they are, so an upper-case id is unknown.
    """
    marked = asked.withColumn("malformed", ~uuid_valid(F.col(asked_id)))
    missing = marked.join(jobs.select(F.col(job_id).alias(asked_id)), asked_id, "left_anti")
    return missing.orderBy(F.desc("malformed"), position)


def jobs_by_ids(jobs: DataFrame, asked: DataFrame, asked_id: str = "asked_id",
                job_id: str = "job_id") -> DataFrame:
    """Job rows for the asked ids in any case; malformed ids are ignored."""
    wanted = asked.where(uuid_valid(F.col(asked_id))).select(F.lower(asked_id).alias(job_id))
    return jobs.join(wanted, job_id, "left_semi")


def company_logo_update(
    companies: DataFrame, logo_map: DataFrame, base_url: str, ignore_case: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Status of every map row, and the company table with the new logos.

    ``logo_map`` has ``input_company, identifier, position``. A row is ``skipped`` without an
    identifier, ``ignored`` without a name, ``missing`` without a company, else ``unchanged``
    or ``updated``. When several rows name one company, the last one sets the logo.
    """
    def key(column: str):
        return F.lower(column) if ignore_case else F.col(column)

    rows = logo_map.withColumn("_key", key("input_company"))
    keyed = companies.withColumn("_key", key("company_name"))
    known = top_k(keyed, ["_key"], [F.desc("company_id")], 1, "_first").select("_key", "company_name", "logo")
    url = F.concat(F.lit(f"{base_url}/"), F.col("identifier"), F.lit(".png"))
    has_id = F.coalesce(F.col("identifier"), F.lit("")) != ""
    has_name = F.coalesce(F.col("input_company"), F.lit("")) != ""
    status = rows.join(known, "_key", "left").withColumn("logo_url", F.when(has_id, url)).withColumn(
        "status",
        F.when(~has_id, "skipped").when(~has_name, "ignored")
        .when(F.col("company_name").isNull(), "missing")
        .when(F.col("logo") == F.col("logo_url"), "unchanged").otherwise("updated"),
    )
    news = top_k(
        status.where(F.col("status") == "updated"), ["company_name"], [F.desc("position")], 1, "_last"
    ).select("company_name", "logo_url")
    updated = companies.join(news, "company_name", "left").withColumn(
        "logo", F.coalesce("logo_url", "logo")
    ).drop("logo_url")
    return status.drop("_key"), updated


def audit_foreign_keys(
    checks: Sequence[tuple[str, DataFrame, Sequence[str], DataFrame | None, Sequence[str]]]
) -> DataFrame:
    """``check, kind, violations``: orphans of a foreign key, or repeated unique keys.

    Each check is (name, table, columns, parent or None, parent columns); without a parent
    the columns must be unique. Null keys satisfy both kinds.
    """
    results = []
    for name, table, columns, parent, parent_columns in checks:
        present = table.select(*columns).dropna()
        if parent is not None:
            keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns)])
            bad, kind = present.join(keys, list(columns), "left_anti"), "orphan"
        else:
            bad = present.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            kind = "duplicate"
        results.append(bad.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check"), F.lit(kind).alias("kind"), "violations"
        ))
    whole = results[0]
    for result in results[1:]:
        whole = whole.unionByName(result)
    return whole


def union_dedup_by_id(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first``, then the rows of ``second`` with new keys; ``tier`` tells which."""
    rest = second.join(first.select(*keys), list(keys), "left_anti")
    return first.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))


def exclusion_union(applied: DataFrame, rejected: DataFrame, cooled: DataFrame,
                    user_id: str = "user_id", job_id: str = "job_id") -> DataFrame:
    """Distinct excluded pairs; rows with a null user hold for every user."""
    everyone = cooled.select(F.lit(None).cast(applied.schema[user_id].dataType).alias(user_id), job_id)
    return applied.select(user_id, job_id).unionByName(rejected.select(user_id, job_id)).unionByName(
        everyone
    ).distinct()


def missing_ids(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.join(found.select(key), key, "left_anti")


def skill_pair_join(
    left: DataFrame, right: DataFrame, pairs: DataFrame, similarities: DataFrame,
    left_id: str = "left_id", right_id: str = "right_id",
) -> DataFrame:
    """Similar skills of asked document pairs: only-left x only-right, via known similarities.

    ``pairs`` lists the (left_id, right_id) to compare, ``left``/``right`` their skills,
    ``similarities`` the rows (skill1, skill2, similarity) worth joining.
    """
    lefts = left.groupBy(left_id).agg(F.collect_set("skill").alias("_left"))
    rights = right.groupBy(right_id).agg(F.collect_set("skill").alias("_right"))
    listed = pairs.select(left_id, right_id).join(lefts, left_id).join(rights, right_id)
    return similar_listed_skills(listed, [left_id, right_id], "_left", "_right", similarities)


def similar_listed_skills(pairs: DataFrame, keys: Sequence[str], left: str, right: str, similarities: DataFrame) -> DataFrame:
    """``*keys, skill1, skill2, similarity``: the same for pairs that hold both skill arrays.

    A pair's own combinations meet the similarities. The other way, over all similar skills of a left one, would make
    as many rows as the graph has edges there, most of them to skills that the right side does not hold. Combinations
    that are not similar are ruled out where the pair lies, by a map of bits; the others are joined.
    """
    known = cut_lineage(similarities.select("skill1", "skill2", "similarity"))
    bits = known.sparkSession.sparkContext.broadcast(pair_map(known, "skill1", "skill2"))
    only = pairs.select(*keys, F.array_except(left, right).alias("_l"), F.array_except(right, left).alias("_r")).where(
        (F.size("_l") > 0) & (F.size("_r") > 0))
    hashed = only.select(*keys, "_l", "_r", *(F.transform(side, lambda x: F.xxhash64(x)) for side in ("_l", "_r")))
    skill = T.StructType([T.StructField(c, T.StringType()) for c in ("skill1", "skill2")])
    asked = hashed.mapInArrow(likely_pairs(list(keys), lambda: bits.value), T.StructType([*(only.schema[k] for k in keys), *skill]))
    return asked.join(known, ["skill1", "skill2"]).select(*keys, "skill1", "skill2", "similarity")
