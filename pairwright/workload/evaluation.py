"""Ranking metrics, embedding diagnostics, splits, batches and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import evaluation, samples, vectors
from pairwright.workload import tables as t
from pairwright.workload.registry import query
from pairwright.workload.rollups import rounded

# suppliers are queries, orders the items; relevant = ordered with a return
def rankings(spark, sf, score="l_extendedprice"):
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("item_id"),
        F.col(score).alias("score"), (F.col("l_returnflag") == "R").alias("is_positive"))
    return evaluation.rank_candidates(rows)


def relevance(spark, sf):
    """Returned lines of the whole table; cut-offs leave many of them outside the first ranks."""
    return t.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("item_id"))


def ranked_sql(name, score):
    """Positives win over negatives, then the higher score."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
  (SELECT l_suppkey AS query_id, l_orderkey AS item_id, bool_or(l_returnflag = 'R') AS is_positive,
  coalesce(max(CASE WHEN l_returnflag = 'R' THEN {score} END), max({score})) AS score FROM lineitem GROUP BY 1, 2))"""


def metrics_sql(ranked, out):
    ks = (5, 10, 25)
    cols = ", ".join(
        f"coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END), 0) AS dcg{k}, coalesce(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0) AS h{k}" for k in ks)
    final = ", ".join(
        f"dcg{k} AS dcg_at_{k}, dcg{k} / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k + 1}) r(i) WHERE i <= n_relevant) AS ndcg_at_{k}, "
        f"h{k} / n_relevant AS recall_at_{k}, h{k} / {k} AS precision_at_{k}" for k in ks)
    return f"""
{out}_n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
{out}_h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM {ranked} WHERE (query_id, item_id) IN (SELECT query_id, item_id FROM rel)),
{out}_a AS (SELECT n.query_id, n_relevant, coalesce(1 / min(rank), 0) AS mrr, coalesce(sum(hits / rank), 0) / n_relevant AS average_precision, {cols}
  FROM {out}_n n LEFT JOIN {out}_h h ON h.query_id = n.query_id GROUP BY 1, 2),
{out} AS (SELECT query_id, n_relevant, mrr, average_precision, {final} FROM {out}_a)"""


REL = "rel AS (SELECT DISTINCT l_suppkey AS query_id, l_orderkey AS item_id FROM lineitem WHERE l_returnflag = 'R')"
METRICS = f"{REL}, {ranked_sql('ranked', 'l_extendedprice')}, {metrics_sql('ranked', 'm')}"


@query("rank_candidates", f"WITH {ranked_sql('ranked', 'l_extendedprice')} SELECT query_id, item_id, is_positive, score, rank FROM ranked")
def _(spark, sf):
    return rankings(spark, sf)


def per_query(spark, sf, score="l_extendedprice"):
    return evaluation.query_metrics(rankings(spark, sf, score), relevance(spark, sf))


def metric_query(name, *columns):
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in columns)

    @query(name, f"WITH {METRICS} SELECT query_id, {listed} FROM m")
    def _(spark, sf):
        return rounded(per_query(spark, sf).select("query_id", *columns))


metric_query("dcg", "dcg_at_5", "dcg_at_10", "dcg_at_25")
metric_query("ndcg_at_k", "ndcg_at_5", "ndcg_at_10", "ndcg_at_25")
metric_query("mrr", "mrr")
metric_query("recall_at_k", "recall_at_5", "recall_at_10", "recall_at_25")
metric_query("precision_at_k", "precision_at_5", "precision_at_10", "precision_at_25")
metric_query("average_precision", "average_precision")

NAMES = evaluation.metric_names()


@query("ranking_report", f"""WITH {METRICS} SELECT count(*) AS num_queries, {', '.join(
    f"round(avg({n}), 6) AS {'map_score' if n == 'average_precision' else n}" for n in NAMES)} FROM m""")
def _(spark, sf):
    return rounded(evaluation.ranking_report(per_query(spark, sf)))


@query("ranking_distributions", f"WITH {METRICS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS std, round(min({n}), 6) AS min, round(max({n}), 6) AS max FROM m" for n in NAMES))
def _(spark, sf):
    return rounded(evaluation.ranking_distributions(per_query(spark, sf)))


@query("metric_averages_by_split", f"""WITH {METRICS}, {ranked_sql('other', 'l_discount')}, {metrics_sql('other', 'o')} """ + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round((SELECT avg({n}) FROM m), 6) AS model_1, round((SELECT avg({n}) FROM o), 6) AS model_2, round((SELECT avg({n}) FROM m) - (SELECT avg({n}) FROM o), 6) AS delta"
    for n in ("ndcg_at_10", "mrr", "recall_at_10")))
def _(spark, sf):
    return rounded(evaluation.compare_models(per_query(spark, sf), per_query(spark, sf, "l_discount")))


@query("embedding_diagnostics", """WITH p AS (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  n AS (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)
  SELECT (SELECT count(*) FROM embeddings) AS num_embeddings, 64 AS embedding_dim, (SELECT round(avg(l), 6) FROM n) AS norm_mean, (SELECT round(stddev_pop(l), 6) FROM n) AS norm_std,
  round(avg(s), 6) AS similarity_mean, round(stddev_pop(s), 6) AS similarity_std, round(min(s), 6) AS similarity_min, round(max(s), 6) AS similarity_max FROM p""")
def _(spark, sf):
    return rounded(vectors.embedding_diagnostics(t.table(spark, sf, "embeddings"), item_id="vec_id"))


@query("class_separation", """WITH p AS (SELECT a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
  m AS (SELECT avg(CASE WHEN same THEN s END) AS intra, avg(CASE WHEN NOT same THEN s END) AS inter FROM p)
  SELECT round(intra, 6) AS intra_class_similarity, round(inter, 6) AS inter_class_similarity, round(intra - inter, 6) AS class_separation FROM m""")
def _(spark, sf):
    return rounded(vectors.class_separation(t.table(spark, sf, "embeddings")))


# --- splits, batches, losses ----------------------------------------------------------------
@query("split_dataset", """WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS split, n - 2 * CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS rows FROM n
  UNION ALL SELECT 'val', CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM n UNION ALL SELECT 'test', CAST(floor(n * 0.1::DOUBLE) AS BIGINT) FROM n""")
def _(spark, sf):
    split = samples.split_dataset(t.table(spark, sf, "orders"), "o_orderkey")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("make_batches", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 64) AS BIGINT) AS batch_id FROM orders""")
def _(spark, sf):
    return samples.make_batches(t.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "batch_id")


@query("shuffled_batches", """WITH n AS (SELECT count(*) AS n FROM orders) SELECT i AS batch_id, least(64, n - i * 64) AS rows FROM n, range(0, CAST(ceil(n / 64) AS BIGINT)) r(i)""")
def _(spark, sf):
    batches = samples.make_batches(t.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", shuffle=True)
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))


def loss_batches(spark, sf):
    """Each vector with the next one as positive and two later ones as negatives, 64 a batch."""
    rows = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("e"))
    def after(step, name):
        return rows.select((F.col("sample_id") - step).alias("sample_id"), F.col("e").alias(name))

    joined = rows.withColumnRenamed("e", "anchor").join(after(1, "positive"), "sample_id").join(
        after(2, "n1"), "sample_id").join(after(3, "n2"), "sample_id")
    return samples.make_batches(joined, "sample_id").select(
        "batch_id", "sample_id", "anchor", "positive", F.array("n1", "n2").alias("negatives"))


@query("contrastive_losses", """WITH s AS (SELECT a.vec_id AS i, floor((row_number() OVER (ORDER BY a.vec_id) - 1) / 64) AS b, a.embedding::DOUBLE[] AS a, p.embedding::DOUBLE[] AS p, x.embedding::DOUBLE[] AS x, y.embedding::DOUBLE[] AS y
  FROM embeddings a JOIN embeddings p ON p.vec_id = a.vec_id + 1 JOIN embeddings x ON x.vec_id = a.vec_id + 2 JOIN embeddings y ON y.vec_id = a.vec_id + 3),
  m AS (SELECT s.b, s.i, r.i AS j, list_cosine_similarity(s.a, r.p) AS c FROM s JOIN s r ON r.b = s.b),
  own AS (SELECT b, i, ln(sum(exp(c / 0.07))) - max(CASE WHEN i = j THEN c / 0.07 END) AS l1, ln(sum(exp(c * 20))) - max(CASE WHEN i = j THEN c * 20 END) AS l2, count(*) AS n FROM m GROUP BY 1, 2),
  hard AS (SELECT m.b, m.i, greatest(0, m.c - d.c + 0.5) AS h, row_number() OVER (PARTITION BY m.b, m.i ORDER BY m.c DESC) AS r FROM m JOIN m d ON d.b = m.b AND d.i = m.i AND d.j = m.i WHERE m.i <> m.j),
  onl AS (SELECT b, avg(h) AS online FROM hard JOIN own USING (b, i) WHERE r <= greatest(1, floor((n - 1) * 0.5)) GROUP BY 1),
  ex AS (SELECT b, avg(ln(exp(list_cosine_similarity(a, p) / 0.07) + exp(list_cosine_similarity(a, x) / 0.07) + exp(list_cosine_similarity(a, y) / 0.07)) - list_cosine_similarity(a, p) / 0.07) AS explicit,
    avg(greatest(0, (1 - list_dot_product(a, p)) - (1 - greatest(list_dot_product(a, x), list_dot_product(a, y))) + 0.2)) AS triplet FROM s GROUP BY 1),
  o AS (SELECT b, count(*) AS n, avg(l1) AS in_batch, avg(l2) AS mnrl FROM own GROUP BY 1)
  SELECT CAST(b AS BIGINT) AS batch_id, n, round(in_batch, 6) AS in_batch, round(explicit, 6) AS explicit, round(triplet, 6) AS triplet, round(mnrl, 6) AS mnrl, round(online, 6) AS online,
  round(in_batch + explicit + triplet, 6) AS total FROM o JOIN ex USING (b) JOIN onl USING (b)""")
def _(spark, sf):
    return rounded(evaluation.contrastive_losses(loss_batches(spark, sf)))


@query("validation_loss")
def _(spark, sf):
    return evaluation.validation_loss(evaluation.contrastive_losses(loss_batches(spark, sf)))
