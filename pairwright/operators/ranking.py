"""Score fusion, re-ranking, and adapters for encoders and pair scorers."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import fixed_values as fv
from pairwright.functions.text import blank_to_null
from pairwright.functions.vectors import dot
from pairwright.operators import blocks
from pairwright.operators.paging import assign_rank, topk_per_query

Encoder = Callable[[Sequence[str]], Sequence[np.ndarray]]
PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in encoder: one pseudo-random vector per word."""

    def word_vector(word: str) -> np.ndarray:
        digest = hashlib.shake_128(word.encode()).digest(dim)
        return np.frombuffer(digest, dtype=np.uint8) / 127.5 - 1.0

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        known: dict[str, np.ndarray] = {}
        result = []
        for text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            for word in words:
                if word not in known:
                    known[word] = word_vector(word)
            result.append(np.array([known[w] for w in words]).reshape(len(words), dim))
        return result

    return encode


def _pool(tokens: np.ndarray, how: str) -> np.ndarray:
    """One unit vector from the token vectors of a text; a text without tokens gives zeros."""
    if tokens.ndim == 1:
        pooled = tokens
    elif len(tokens) == 0:
        pooled = np.zeros(tokens.shape[1])
    elif how == "cls":
        pooled = tokens[0]
    elif how == "max":
        pooled = tokens.max(axis=0)
    else:
        pooled = tokens.mean(axis=0)
    length = np.linalg.norm(pooled)
    return pooled / length if length > 0 else pooled


def encode_text(df: DataFrame, text: str, name: str = "embedding", encoder: Encoder | None = None,
                pooling: str = "mean", batch_rows: int = 32) -> DataFrame:
    """Unit-length embeddings of a text column, computed in Arrow batches.

    ``encoder`` maps texts to token matrices (pooled here) or to finished vectors.
    """
    if pooling not in ("mean", "cls", "max"):
        raise ValueError(f"unknown pooling {pooling}")
    encode = encoder or hashing_encoder()

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = []
            for start in range(0, len(texts), batch_rows):
                rows += [
                    _pool(np.asarray(t, dtype=np.float64), pooling).tolist()
                    for t in encode(texts[start:start + batch_rows])
                ]
            yield pd.Series(rows, index=batch.index)

    return df.withColumn(name, embed(text))


def overlap_scorer(left: Sequence[str], right: Sequence[str]) -> list[float]:
    """A deterministic stand-in pair scorer: word-set overlap."""
    scores = []
    for a, b in zip(left, right):
        x, y = (set(re.findall(r"\w+", (t or "").lower())) for t in (a, b))
        scores.append(len(x & y) / len(x | y) if x | y else 0.0)
    return scores


def score_text_pairs(df: DataFrame, left: str, right: str, name: str = "cross_score",
                     scorer: PairScorer = overlap_scorer, batch_rows: int = 32) -> DataFrame:
    """Scores of text pairs in Arrow batches; use it on rows already cut to the best k."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            x, y = a.fillna("").tolist(), b.fillna("").tolist()
            values: list[float] = []
            for start in range(0, len(x), batch_rows):
                values += scorer(x[start:start + batch_rows], y[start:start + batch_rows])
            yield pd.Series(values, dtype="float64", index=a.index)

    return df.withColumn(name, score(left, right))


def candidate_text(description: Column, short_description: Column) -> Column:
    """The description, else the short one."""
    return F.coalesce(blank_to_null(description), short_description)


def biencoder_scores(pairs: DataFrame, query_vector: str | None, item_vector: str | None,
                     name: str = "bi_score") -> DataFrame:
    """Dot product of both vectors; a constant 0.5 without an encoder."""
    if query_vector is None or item_vector is None:
        return pairs.withColumn(name, F.lit(0.5))
    return pairs.withColumn(name, dot(F.col(query_vector), F.col(item_vector)))


def score_pairs(
    pairs: DataFrame, queries: DataFrame, items: DataFrame, *, query_id: str, item_id: str,
    query_vector: str, item_vector: str, name: str = "bi_score",
    block_rows: int = 32_768, pair_rows: int = 1_000_000,
) -> DataFrame:
    """``pairs`` with the dot product of their vectors, which are given by id; pairs with an unknown id have no row.

    Vectors are cut into blocks by a hash of their id and sent to the pairs of blocks; a pair travels once, as its own
    columns, and no pair carries a vector. Where few vectors have many pairs, a pair of blocks is dealt over several tasks.
    """
    asked = pairs.where(F.col(query_id).isNotNull() & F.col(item_id).isNotNull())
    n_pairs, n_queries, n_items = (df.count() for df in (asked, queries, items))
    nq, ni = (max(1, math.ceil(n / block_rows)) for n in (n_queries, n_items))
    parts = max(1, math.ceil(n_pairs / (pair_rows * nq * ni)))

    def block(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = asked.withColumns({
        "_qb": block(query_id, nq), "_ib": block(item_id, ni),
        "_part": F.pmod(F.xxhash64(F.lit(7), *asked.columns), F.lit(parts)).cast("int")})
    known_queries = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v")).withColumn(
        "_qb", block("_q", nq)).withColumn("_ib", every(ni)).withColumn("_part", every(parts))
    known_items = items.select(F.col(item_id).alias("_i"), F.col(item_vector).alias("_v")).withColumn(
        "_ib", block("_i", ni)).withColumn("_qb", every(nq)).withColumn("_part", every(parts))
    known = known_queries.unionByName(known_items, allowMissingColumns=True)
    columns = asked.columns

    def met(asked_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both sides with one id."""
        order = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids[order], asked_ids, side) for side in ("left", "right"))
        count = high - low
        rows = np.repeat(np.arange(len(asked_ids)), count)
        return rows, order[np.arange(len(rows)) - np.repeat(np.cumsum(count) - count - low, count)]

    def run(some: pa.Table, vectors: pa.Table) -> pa.Table:
        of_query = vectors.filter(pc.is_valid(vectors.column("_q")))
        of_item = vectors.filter(pc.is_valid(vectors.column("_i")))
        if pc.list_flatten(vectors.column("_v")).null_count:
            raise ValueError("vectors with null entries have no product")
        rows, q = met(some.column(query_id).to_numpy(), of_query.column("_q").to_numpy())
        again, i = met(some.column(item_id).to_numpy()[rows], of_item.column("_i").to_numpy())
        rows, q = rows[again], q[again]
        scores = np.full(len(rows), np.nan)
        has = [pc.is_valid(side.column("_v")).to_numpy() for side in (of_query, of_item)]
        full = np.flatnonzero(has[0][q] & has[1][i])
        if len(full):
            tables = [blocks.matrix(side.column("_v").filter(pc.is_valid(side.column("_v")))) for side in (of_query, of_item)]
            places = [np.cumsum(h) - 1 for h in has]
            step = blocks.chunk_rows(tables[0].shape[1])
            for start in range(0, len(full), step):
                at = full[start:start + step]
                scores[at] = np.einsum("ij,ij->i", tables[0][places[0][q[at]]], tables[1][places[1][i[at]]])
        unknown = np.ones(len(rows), bool)
        unknown[full] = False
        return some.select(columns).take(pa.array(rows)).append_column(name, pa.array(scores, pa.float64(), mask=unknown))

    schema = T.StructType([*asked.schema.fields, T.StructField(name, T.DoubleType())])
    keys = ["_qb", "_ib", "_part"]
    return left.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(run, schema)


def fuse_scores(
    candidates: DataFrame, query_id: str = "query_id", item_id: str = "item_id",
    retrieve: int = fv.RETRIEVE_ROWS, keep: int = fv.FINAL_ROWS,
) -> DataFrame:
    """Best ``retrieve`` by ``bi_score``, fused with ``cross_score`` and ``skill_score``.

    A null cross score leaves the bi score at full weight; the skill part is then added.
    """
    retrieved = topk_per_query(candidates, retrieve, "bi_score", query_id, item_id, "_bi_rank")
    bi, cross, skill = (F.col(c) for c in ("bi_score", "cross_score", "skill_score"))
    base = F.when(cross.isNotNull(), bi * fv.BI_WEIGHT + cross * fv.CROSS_WEIGHT).otherwise(bi)
    final = base + F.coalesce(skill * fv.SKILL_WEIGHT, F.lit(0.0))
    scored = retrieved.withColumn("final_score", F.round(final, 9))
    return assign_rank(scored, "final_score", query_id, item_id, keep).drop("_bi_rank")


def rerank_two_stage(
    candidates: DataFrame, query_id: str = "query_id", item_id: str = "item_id",
    retrieve: int = fv.RETRIEVE_ROWS, keep: int = fv.FINAL_ROWS,
    score_stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Best ``retrieve`` by bi score, re-ranked by 0.7 cross + 0.3 bi, best ``keep``.

    ``score_stage`` adds ``cross_score`` to the retrieved rows (see ``score_text_pairs``); other
    columns are carried along.
    """
    first = topk_per_query(candidates, retrieve, "bi_score", query_id, item_id, "bi_rank")
    scored = score_stage(first) if score_stage else first
    final = F.col("cross_score") * fv.RERANK_CROSS_WEIGHT + F.col("bi_score") * fv.RERANK_BI_WEIGHT
    return assign_rank(
        scored.withColumn("final_score", F.round(final, 9)), "final_score", query_id, item_id, keep
    )


def stale_match_keys(
    matches: DataFrame, applied: DataFrame, rejected: DataFrame, cooled: DataFrame,
    as_of: Column, request_id: str = "request_id", ttl_seconds: int = fv.MATCH_TTL_SECONDS,
) -> DataFrame:
    """Per stored request: size, survivors of today's exclusions, and whether to recompute.

    ``matches`` has ``request_id, user_id, job_id, created``. A result is reused while it is
    fresh and either 25 jobs survive or it was small (below 50) to begin with.
    """
    keys = ["user_id", "job_id"]
    gone = applied.select(*keys).unionByName(rejected.select(*keys)).distinct().withColumn("_gone", F.lit(1))
    cold = cooled.select("job_id").distinct().withColumn("_cold", F.lit(1))
    marked = matches.join(gone, keys, "left").join(cold, "job_id", "left")
    alive = F.col("_gone").isNull() & F.col("_cold").isNull()
    limit = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds))
    return marked.groupBy(request_id).agg(
        F.count(F.lit(1)).alias("stored"),
        F.sum(F.when(alive, 1).otherwise(0)).alias("survivors"),
        F.max("created").alias("_created"),
    ).withColumn(
        "recompute",
        (F.col("_created") < limit)
        | ((F.col("survivors") < fv.STALE_SURVIVORS) & (F.col("stored") >= fv.STALE_SMALL_RESULT)),
    ).drop("_created")


def distinct_requests(requests: DataFrame, key: str = "request_key", pick: str = "request_id") -> DataFrame:
    """One representative per request key with the number of requests it stands for."""
    return requests.groupBy(key).agg(F.min(pick).alias(pick), F.count(F.lit(1)).alias("requests"))
