"""Ranking metrics and losses on precomputed embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators.skew import bucket_of, positions_by_bucket, running_sum_by_rank, value_bounds


def rank_candidates(candidates: DataFrame, query_id: str = "query_id", item_id: str = "item_id",
                    score: str = "score", positive: str = "is_positive", buckets: int = 16) -> DataFrame:
    """One row per (query, item), positives winning over negatives, ranked by falling score."""
    single = candidates.groupBy(query_id, item_id).agg(
        F.max(positive).alias(positive),
        F.max_by(score, F.struct(positive, score)).alias(score),
    )
    bounds = value_bounds(single.select((-F.col(score)).alias("_s")), "_s", buckets)
    placed = single.withColumn("_b", bucket_of(-F.col(score), bounds))
    return positions_by_bucket(
        placed, "_b", [F.desc(score), F.asc(item_id)], "rank", [query_id]
    ).drop("_b")


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def ideal_dcg(relevant: Column, k: int) -> Column:
    """DCG of a ranking that puts min(relevant, k) relevant items first."""
    steps = F.sequence(F.lit(1), F.least(relevant, F.lit(k)).cast("int"))
    return F.aggregate(steps, F.lit(0.0), lambda total, i: total + 1.0 / F.log2(i + 1))


def running_hits(hits: DataFrame, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """Hits so far at each relevant rank, counted over rank ranges."""
    return running_sum_by_rank(hits, [query_id], rank, F.lit(1), "hits_so_far")


def query_metrics(
    ranking: DataFrame, relevance: DataFrame, cutoffs: Sequence[int] = fv.RANKING_CUTOFFS,
    query_id: str = "query_id", item_id: str = "item_id", rank: str = "rank",
) -> DataFrame:
    """All metrics per query with at least one relevant item.

    Only relevant rows travel: the ranking is reduced to its hits first, and queries without
    a hit come back from the relevance table with zeros.
    """
    relevant = relevance.select(query_id, item_id).distinct()
    totals = relevant.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranking.select(query_id, item_id, rank).join(relevant, [query_id, item_id], "left_semi")
    counted = running_hits(hits, query_id, rank)
    r = F.col(rank)
    aggregates = [
        (1.0 / F.min(r)).alias("mrr"),
        F.sum(F.col("hits_so_far") / r).alias("_ap"),
    ]
    for k in cutoffs:
        inside = r <= k
        aggregates += [
            F.sum(F.when(inside, discount(r))).alias(f"dcg_at_{k}"),
            F.sum(F.when(inside, 1).otherwise(0)).alias(f"_hits_{k}"),
        ]
    found = counted.groupBy(query_id).agg(*aggregates)
    joined = totals.join(found, query_id, "left").fillna(0)
    n = F.col("n_relevant")
    columns = [
        query_id, "n_relevant", F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        (F.coalesce("_ap", F.lit(0.0)) / n).alias("average_precision"),
    ]
    for k in cutoffs:
        columns += [
            F.col(f"dcg_at_{k}"),
            (F.col(f"dcg_at_{k}") / ideal_dcg(n, k)).alias(f"ndcg_at_{k}"),
            (F.col(f"_hits_{k}") / n).alias(f"recall_at_{k}"),
            (F.col(f"_hits_{k}") / F.lit(k)).alias(f"precision_at_{k}"),
        ]
    return joined.select(*columns)


def metric_names(cutoffs: Sequence[int] = fv.RANKING_CUTOFFS) -> list[str]:
    kinds = ("ndcg", "recall", "precision")
    return ["mrr", "average_precision", *[f"{m}_at_{k}" for m in kinds for k in cutoffs]]


def ranking_report(metrics: DataFrame, cutoffs: Sequence[int] = fv.RANKING_CUTOFFS,
                   by: Sequence[str] = ()) -> DataFrame:
    """Mean of every metric over queries, as one row (per ``by``)."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias("map_score" if m == "average_precision" else m)
             for m in metric_names(cutoffs)]
    grouped = metrics.groupBy(*by) if by else metrics
    return grouped.agg(F.count(F.lit(1)).alias("num_queries"), *means)


def ranking_distributions(metrics: DataFrame, cutoffs: Sequence[int] = fv.RANKING_CUTOFFS) -> DataFrame:
    """``metric, mean, std, min, max`` over queries, one row per metric."""
    names = metric_names(cutoffs)
    long = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names
    ])).alias("_m")).select("_m.*")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def compare_models(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """``metric, model_1, model_2, delta`` of two models' per-query metrics."""
    names = [f"ndcg_at_{k}", "mrr", f"recall_at_{k}"]
    both = first.select(F.lit(1).alias("_model"), *names).unionByName(
        second.select(F.lit(2).alias("_model"), *names)
    )
    long = both.select("_model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names
    ])).alias("_m")).select("_model", "_m.*")
    wide = long.groupBy("metric").agg(
        F.avg(F.when(F.col("_model") == 1, F.col("value"))).alias("model_1"),
        F.avg(F.when(F.col("_model") == 2, F.col("value"))).alias("model_2"),
    )
    return wide.withColumn("delta", F.col("model_1") - F.col("model_2"))


# --- losses -----------------------------------------------------------------------
def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.maximum(lengths, 1e-12)


def _cross_entropy(logits: np.ndarray, target: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    log_sum = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
    return float(np.mean(log_sum - logits[np.arange(len(logits)), target]))


def contrastive_losses(
    batches: DataFrame, temperature: float = fv.TEMPERATURE, margin: float = 0.2,
    scale: float = fv.MNRL_SCALE, online_margin: float = fv.ONLINE_MARGIN,
    online_ratio: float = fv.ONLINE_HARD_RATIO, hard_weight: float = 1.0,
    max_batch: int = 4096,
) -> DataFrame:
    """Losses per ``batch_id`` of rows ``anchor, positive, negatives`` (no gradients).

    Batches are small by construction (see ``make_batches``); a larger one is an error,
    not a silent memory risk.
    """
    names = ["in_batch", "explicit", "triplet", "mnrl", "online", "total"]

    def losses(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > max_batch:
            raise ValueError(f"batch {key[0]} has {len(frame)} rows, more than {max_batch}")
        frame = frame.sort_values("sample_id")
        raw_a, raw_p = (np.stack(frame[c].to_numpy()).astype(float) for c in ("anchor", "positive"))
        a, p = _unit(raw_a), _unit(raw_p)
        n, own = len(frame), np.arange(len(frame))
        sims = a @ p.T
        in_batch = _cross_entropy(sims / temperature, own)
        mnrl = _cross_entropy(sims * scale, own)
        explicit = triplet = None
        counts = frame["negatives"].map(lambda v: 0 if v is None else len(v))
        if counts.min() > 0 and counts.min() == counts.max():
            raw_n = np.stack([np.stack(list(v)) for v in frame["negatives"]]).astype(float)
            far = np.einsum("bnd,bd->bn", _unit(raw_n), a)
            logits = np.concatenate([np.sum(a * p, axis=1, keepdims=True), far], axis=1) / temperature
            explicit = _cross_entropy(logits, np.zeros(n, dtype=int))
            near = 1 - np.sum(raw_a * raw_p, axis=1)
            hardest = 1 - np.einsum("bnd,bd->bn", raw_n, raw_a).max(axis=1)
            triplet = float(np.maximum(near - hardest + margin, 0).mean())
        online = None
        if n > 1:
            others = sims[~np.eye(n, dtype=bool)].reshape(n, n - 1)
            hard = max(1, int((n - 1) * online_ratio))
            worst = -np.sort(-others, axis=1)[:, :hard]
            online = float(np.maximum(worst - np.diag(sims)[:, None] + online_margin, 0).mean())
        total = in_batch + (hard_weight * explicit if explicit is not None else 0.0) + (triplet or 0.0)
        return pd.DataFrame([[key[0], n, in_batch, explicit, triplet, mnrl, online, total]],
                            columns=["batch_id", "n", *names])

    schema = "batch_id bigint, n int, " + ", ".join(f"{name} double" for name in names)
    chosen = batches.select(F.col("batch_id").cast("bigint").alias("batch_id"), "sample_id",
                            "anchor", "positive", "negatives")
    return chosen.groupBy("batch_id").applyInPandas(losses, schema)


def validation_loss(losses: DataFrame) -> DataFrame:
    """Mean total loss over batches, negated so that larger is better."""
    return losses.agg((-F.avg("total")).alias("validation_score"), F.count(F.lit(1)).alias("batches"))
