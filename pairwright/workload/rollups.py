"""Aggregates and window-like computations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import aggregates, quantiles
from pairwright.operators import graph as graph_ops
from pairwright.operators.evaluation import running_hits
from pairwright.operators.paging import assign_rank
from pairwright.operators.skills import first_skill_mention
from pairwright.operators.vectors import pool_vectors
from pairwright.workload import tables as t
from pairwright.workload.columns import LINEAR_SQL, SIGMOID_SQL
from pairwright.workload.joins import CANDIDATES, candidate_lists
from pairwright.workload.registry import query
from pairwright.workload.sources import GRAPH, SAMPLES, part_graph, samples


def rounded(df, *keys, digits=6):
    """Round every double column that is not a key."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles and c not in keys else F.col(c) for c in df.columns])


@query("fold_job_fields", """WITH m AS (SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F')
  SELECT m.job_id, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS roots, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS subs
  FROM m LEFT JOIN lineitem ON l_orderkey = m.job_id LEFT JOIN part ON p_partkey = l_partkey GROUP BY m.job_id
  HAVING count(p_brand) > 0 UNION ALL SELECT job_id, NULL, NULL FROM m WHERE job_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, sf):
    matches = t.applied(spark, sf).select("job_id")
    folded = aggregates.fold_job_fields(matches, t.field_jobs(spark, sf), t.fields(spark, sf))
    return folded.select("job_id", F.array_join("root_fields", ",").alias("roots"), F.array_join("sub_fields", ",").alias("subs"))


@query("fields_catalog", "SELECT p_brand AS root_field, p_type AS sub_field, p_partkey AS field_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part")
def _(spark, sf):
    return aggregates.fields_catalog(t.fields(spark, sf))


@query("score_distribution", """SELECT user_id, event_type, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
  CASE WHEN count(value) > 1 THEN round(stddev_samp(value), 6) END AS stdev, CASE WHEN count(value) > 1 THEN round(quantile_cont(value, 0.5), 6) END AS median
  FROM events GROUP BY user_id, event_type""")
def _(spark, sf):
    return rounded(aggregates.score_distribution(t.table(spark, sf, "events"), "value", ["user_id", "event_type"]))


_CUTS = ", ".join(f"round(quantile_cont({{v}}, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99))


@query("score_percentiles", f"""SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_pop(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median, {_CUTS.format(v='l_extendedprice').replace(', 6)', ', 4)')} FROM lineitem""")
def _(spark, sf):
    return rounded(aggregates.score_percentiles(t.table(spark, sf, "lineitem"), "l_extendedprice"), digits=4)


def distances(spark, sf):
    return t.table(spark, sf, "events").select((F.col("value") / 200).alias("d"))


@query("score_threshold_share", f"""WITH b AS (SELECT 'linear' AS mapping, {LINEAR_SQL.format(d='(value / 200)')} AS p FROM events
  UNION ALL SELECT 'sigmoid', {SIGMOID_SQL.format(d='(value / 200)')} FROM events)
  SELECT mapping, round(avg(CASE WHEN p > 80 THEN 100.0::DOUBLE ELSE 0 END), 6) AS above_80, round(avg(CASE WHEN p > 60 THEN 100.0::DOUBLE ELSE 0 END), 6) AS above_60,
  round(avg(CASE WHEN p > 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS above_0 FROM b GROUP BY mapping""")
def _(spark, sf):
    return rounded(aggregates.score_threshold_share(distances(spark, sf), "d"))


@query("score_transform_compare", f"""WITH d AS (SELECT value / 200 AS d FROM events),
  q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS point, unnest(quantile_cont(d, [0.1, 0.25, 0.5, 0.75, 0.9])) AS raw FROM d),
  hit AS (SELECT point, raw, (SELECT min(d) FROM d WHERE d >= raw) AS x FROM q)
  SELECT 'percentile' AS kind, point, round(raw, 6) AS raw, round({LINEAR_SQL.format(d='x')}, 6) AS linear, {SIGMOID_SQL.format(d='x')} AS sigmoid FROM hit
  UNION ALL SELECT 'fixed', p, p, {LINEAR_SQL.format(d='p')}, {SIGMOID_SQL.format(d='p')}
  FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0, 1.5, 2.0]::DOUBLE[]) AS p)""")
def _(spark, sf):
    return rounded(aggregates.score_transform_compare(distances(spark, sf), "d"))


@query("score_histogram", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem)
  SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INT) AS bin, count(*) AS count,
  round(count(*) / (max(n) * ((max(hi) - max(lo)) / 30)), 12) AS density FROM lineitem CROSS JOIN s GROUP BY 1""")
def _(spark, sf):
    return rounded(aggregates.score_histogram(t.table(spark, sf, "lineitem"), "l_extendedprice"), digits=12)


@query("score_gaussian_fit", "SELECT round(avg(l_extendedprice), 4) AS mu, round(stddev_pop(l_extendedprice), 4) AS sigma FROM lineitem")
def _(spark, sf):
    return rounded(aggregates.score_gaussian_fit(t.table(spark, sf, "lineitem"), "l_extendedprice"), digits=4)


@query("dataset_statistics", f"""WITH {SAMPLES} SELECT 'all' AS kind, 'all' AS name, count(*) AS count, round(avg(negatives), 6) AS avg_hard_negatives FROM samples
  UNION ALL SELECT 'source', source, count(*), round(avg(negatives), 6) FROM samples GROUP BY source
  UNION ALL SELECT 'mining_strategy', mining_strategy, count(*), round(avg(negatives), 6) FROM samples GROUP BY mining_strategy""")
def _(spark, sf):
    known = samples(spark, sf).fillna("combined", ["mining_strategy"])
    return rounded(aggregates.dataset_statistics(known))


@query("miner_statistics", """SELECT count(*) AS documents, count(CASE WHEN text <> '' THEN 1 END) AS texts, count(vec_id) AS embeddings
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def _(spark, sf):
    docs, vectors = t.table(spark, sf, "documents"), t.table(spark, sf, "embeddings")
    return aggregates.miner_statistics(docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left"))


@query("skill_embedding_pool", """WITH v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  m AS (SELECT l_orderkey AS g, pos, avg(x) AS x FROM lineitem JOIN v ON vec_id = l_partkey GROUP BY 1, 2)
  SELECT o_orderkey AS g, round(coalesce(sum(x), 0), 6) AS total, round(coalesce(sum(x * x), 0), 6) AS squares FROM orders LEFT JOIN m ON g = o_orderkey GROUP BY 1""")
def _(spark, sf):
    members = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("skill"))
    vectors = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("skill"), F.col("embedding").alias("v"))
    everyone = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("g"))
    pooled = pool_vectors(members, vectors, "g", "skill", "v", 64, everyone)
    add = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + f(x)), 6)
    return pooled.select("g", add(lambda x: x).alias("total"), add(lambda x: x * x).alias("squares"))


@query("skill_vector", """SELECT l_orderkey AS doc_id, string_agg(f || '=' || d, ',' ORDER BY f) AS vector FROM
  (SELECT l_orderkey, l_returnflag AS f, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    lines = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("skill"), F.col("l_discount").alias("confidence"))
    vector = aggregates.skill_vector(lines)
    shown = F.array_join(F.transform(F.map_entries("skill_vector"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return vector.select("doc_id", shown.alias("vector"))


@query("graph_statistics", f"""WITH {GRAPH} SELECT (SELECT count(*) FROM parts) AS num_nodes, count(*) AS num_edges, 6 AS num_relation_types,
  round(count(*) / (SELECT count(*) FROM parts), 6) AS avg_degree FROM edges""")
def _(spark, sf):
    parts, relations = part_graph(spark, sf)
    return rounded(graph_ops.graph_statistics(parts, graph_ops.skill_edges(relations)))


@query("algorithm_usage", "SELECT event_type AS path, props AS reason, count(*) AS uses FROM events GROUP BY 1, 2")
def _(spark, sf):
    return aggregates.algorithm_usage(t.table(spark, sf, "events"), "event_type", "props").select(
        F.col("event_type").alias("path"), F.col("props").alias("reason"), "uses")


@query("match_counts", "SELECT o_custkey AS request_id, count(*) AS matches FROM orders GROUP BY 1")
def _(spark, sf):
    return aggregates.match_counts(t.table(spark, sf, "orders").select(F.col("o_custkey").alias("request_id")))


@query("latency_summary", """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def _(spark, sf):
    return rounded(aggregates.latency_summary(t.table(spark, sf, "events"), "value", ["event_type"]))


@query("cache_hit_rate", """WITH e AS (SELECT user_id % 10 AS operation, value, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('view', 'click') THEN 'hit' ELSE 'miss' END AS o FROM events)
  SELECT operation, CAST(sum(CASE WHEN o = 'hit' THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN o = 'miss' THEN 1 ELSE 0 END) AS BIGINT) AS misses,
  CAST(sum(CASE WHEN o = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  round(sum(CASE WHEN o = 'hit' THEN 1 ELSE 0 END) / sum(CASE WHEN o <> 'error' THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(value), 6) AS mean_latency FROM e GROUP BY 1""")
def _(spark, sf):
    events = t.table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("operation"), F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("view", "click"), "hit")
        .otherwise("miss").alias("outcome"))
    return rounded(aggregates.cache_hit_rate(events))


# --- window-like --------------------------------------------------------------------------
@query("assign_rank", """SELECT o_custkey AS query_id, o_orderkey AS item_id, o_totalprice AS final_score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 25""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("final_score"))
    return assign_rank(rows)


@query("normalize_by_group_max", f"""WITH {CANDIDATES} SELECT query_id, item_id,
  round(bm25_score / CASE WHEN max(bm25_score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(bm25_score) OVER (PARTITION BY query_id) END, 6) AS scaled FROM merged""")
def _(spark, sf):
    from pairwright.operators.joins import merge_candidates

    scaled = aggregates.normalize_by_group_max(merge_candidates(*candidate_lists(spark, sf)), ["query_id"], "bm25_score", "scaled")
    return rounded(scaled.select("query_id", "item_id", "scaled"))


@query("running_hits", """WITH r AS (SELECT l_suppkey AS query_id, l_returnflag, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
  SELECT query_id, rank, CAST(sum(1) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS hits_so_far FROM r WHERE l_returnflag = 'R'""")
def _(spark, sf):
    from pairwright.operators.skew import bucket_of, positions_by_bucket, value_bounds

    lines = t.table(spark, sf, "lineitem")
    bounds = value_bounds(lines.select((-F.col("l_extendedprice")).alias("p")), "p", 16)
    ranked = positions_by_bucket(
        lines.withColumn("b", bucket_of(-F.col("l_extendedprice"), bounds)), "b",
        [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], "rank", ["l_suppkey"])
    hits = ranked.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("query_id"), "rank")
    return running_hits(hits)


@query("empirical_cdf", """SELECT l_extendedprice AS value, count(*) AS count,
  round(sum(count(*)) OVER (ORDER BY l_extendedprice) / (SELECT count(*) FROM lineitem), 9) AS cdf FROM lineitem GROUP BY 1""")
def _(spark, sf):
    cdf = aggregates.empirical_cdf(t.table(spark, sf, "lineitem"), "l_extendedprice")
    return cdf.select(F.col("l_extendedprice").alias("value"), "count", F.round("cdf", 9).alias("cdf"))


@query("first_skill_mention", """SELECT l_orderkey AS doc_id, l_returnflag AS skill, l_linenumber AS pattern_order, l_partkey AS start_pos FROM (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def _(spark, sf):
    mentions = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("skill"),
        F.col("l_linenumber").alias("pattern_order"), F.col("l_partkey").alias("start_pos"))
    return first_skill_mention(mentions)


@query("exact_percentiles", """SELECT l_suppkey, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share,
  round(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])), 4) AS value FROM lineitem GROUP BY 1""")
def _(spark, sf):
    rows = quantiles.exact_percentiles(t.table(spark, sf, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.9), ["l_suppkey"])
    return rounded(rows, "share", digits=4)
