"""Current state of tables from their change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_rejections(log: DataFrame, user_id: str = "user_id", job_id: str = "job_id",
                     action: str = "action", time: str = "timestamp", order: str = "seq") -> DataFrame:
    """Rejections in force: the first ``pass`` after the last ``undo`` of a key.

    ``order`` breaks equal times. Both steps are plain aggregates, so they combine before
    the shuffle whatever the key.
    """
    at = F.struct(F.col(time), F.col(order))
    keys = [user_id, job_id]
    last_undo = log.where(F.col(action) == "undo").groupBy(*keys).agg(F.max(at).alias("_undo"))
    passes = log.where(F.col(action) == "pass").select(*keys, time, at.alias("_at"))
    standing = passes.join(last_undo, keys, "left").where(
        F.col("_undo").isNull() | (F.col("_at") > F.col("_undo"))
    )
    return standing.groupBy(*keys).agg(F.min(time).alias(time))


def upsert_preferences(log: DataFrame, user_id: str = "user_id", value: str = "experience",
                       time: str = "timestamp", order: str = "seq") -> DataFrame:
    """The last written value per user."""
    return log.groupBy(user_id).agg(F.max_by(value, F.struct(time, order)).alias(value))


def dedupe_jobs_load(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per unique key; rows with a null in the key never collide."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    first = (
        rows.where(complete).groupBy(*keys)
        .agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row"))
        .select("_row.*")
    )
    return first.unionByName(rows.where(~complete))


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str = "job_id") -> DataFrame:
    """Child rows left after their parents are deleted."""
    return children.join(deleted.select(key), key, "left_anti")


def match_freshness(matches: DataFrame, as_of: Column, created: str = "created",
                    seconds: int = 300) -> DataFrame:
    """Stored matches that are still valid."""
    return matches.where(
        F.col(created) >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    )


def task_latest_status(updates: DataFrame, as_of: Column, expiry_seconds: int = 3600,
                       task_id: str = "task_id", order: str = "seq") -> DataFrame:
    """Status and last known result per task; tasks older than the expiry are expired.

    ``updates`` has ``task_id, status, result, created, updated``; ties go to ``order``.
    """
    at = F.struct("updated", order)
    latest = updates.groupBy(task_id).agg(
        F.max_by("status", at).alias("_status"),
        F.max_by("result", F.when(F.col("result").isNotNull(), at)).alias("result"),
        F.min("created").alias("created"), F.max("updated").alias("updated"),
    )
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(expiry_seconds))
    return latest.withColumn(
        "status", F.when(F.col("created") < limit, F.lit("expired")).otherwise(F.col("_status"))
    ).drop("_status")
