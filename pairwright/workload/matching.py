"""Vector search, the flagship matching job, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions.vectors import cosine_similarity as cosine
from pairwright.operators import ranking, vectors
from pairwright.operators.skills import skill_graph_scores as overlap
from pairwright.plans.match import match_user_jobs, ranked_matches, search_by_date_requests
from pairwright.plans.retrieval import multi_stage_matches
from pairwright.session import scratch_path
from pairwright.workload import tables as t
from pairwright.workload.columns import SIGMOID_SQL
from pairwright.workload.paging import DATE_KEY, RECOMMENDED
from pairwright.workload.registry import query
from pairwright.workload.rollups import rounded

PAIR = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query("cosine_similarity", f"SELECT a.vec_id, round({PAIR}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    rows = t.table(spark, sf, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def search_sides(spark, sf):
    rows = t.table(spark, sf, "embeddings")
    return (rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
            rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector")))


@query("vector_topk_join", f"""SELECT query_id, item_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(1 - {PAIR}, 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 20""")
def _(spark, sf):
    found = vectors.vector_topk_join(*search_sides(spark, sf), 20, skip_self=True)
    return found.withColumn("distance", F.round("distance", 6))


@query("vector_topk_cells_exact", f"""SELECT query_id, item_id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(1 - {PAIR}, 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def _(spark, sf):
    queries, items = search_sides(spark, sf)
    centres = vectors.fit_cells(items, "item_vector", cells=8, rounds=5)
    found = vectors.vector_topk_cells(queries, items, 10, centres, probes=2, exact=True, skip_self=True)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_topk_cells_recall")
def _(spark, sf):
    """Recall of the approximate search against the exact one."""
    queries, items = search_sides(spark, sf)
    centres = vectors.fit_cells(items, "item_vector", cells=8, rounds=5)
    near = vectors.vector_topk_cells(queries, items, 10, centres, probes=3, skip_self=True)
    exact = vectors.vector_topk_join(queries, items, 10, skip_self=True)
    return vectors.recall_at_k(near, exact, "query_id", "item_id")


# --- flagship ------------------------------------------------------------------------------
def match_requests(spark, sf):
    """Every vector asks as a user: a third by country, a third by level, a third unfiltered; a few come without a vector."""
    key = F.col("vec_id")
    nothing = F.lit(None).cast("string")
    region = F.element_at(F.array(*[F.lit(r) for r in ("AFRICA", "USA", "ASIA", "EUROPE", "MIDDLE EAST")]), (key % 5 + 1).cast("int"))
    loc = F.array(F.struct(
        region.alias("country"), nothing.alias("city"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("double").alias("radius_km")))
    return t.table(spark, sf, "embeddings").select(
        key.alias("request_id"), (key % 150).alias("user_id"), F.when(key % 37 != 5, F.col("embedding")).alias("request_vector"),
        F.when(key % 3 == 0, loc).alias("locations"), F.lit(None).cast("array<string>").alias("keywords"),
        F.when(key % 3 == 1, F.array(F.lit("Senior-level"), F.lit("Mid-level"))).alias("experience"),
        nothing.alias("company"), F.lit(False).alias("is_remote_only"),
        F.lit(None).cast("array<int>").alias("fields"),
        F.element_at(F.array(F.lit("recommended"), F.lit("date"), F.lit("matching_score")), (key % 3 + 1).cast("int")).alias("sort_type"),
        F.when(key % 4 == 0, 25).otherwise(0).alias("offset"))


def match_jobs(spark, sf):
    vectors_ = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), F.col("embedding").alias("job_vector"))
    return vectors_.join(t.flat_jobs(spark, sf), "job_id")


def match_exclusions(spark, sf):
    cooled = t.table(spark, sf, "events").where("event_type = 'view' AND value > 280").select(
        (F.col("event_id") % t.n_vectors(spark, sf)).alias("job_id"))
    return t.event_pairs(spark, sf, "error"), t.event_pairs(spark, sf, "signup"), cooled


MATCH = f"""
{t.STAR},
req AS (SELECT vec_id AS request_id, vec_id % 150 AS user_id, embedding,
  CASE WHEN vec_id % 3 = 0 THEN ['AFRICA', 'United States', 'ASIA', 'EUROPE', 'MIDDLE EAST'][vec_id % 5 + 1] END AS want,
  vec_id % 3 = 1 AS lev, ['recommended', 'date', 'matching_score'][vec_id % 3 + 1] AS sort_type, CASE WHEN vec_id % 4 = 0 THEN 25 ELSE 0 END AS off, vec_id % 37 = 5 AS guest FROM embeddings),
live AS (SELECT f.*, embedding FROM flat f JOIN embeddings ON vec_id = job_id WHERE job_id NOT IN (SELECT event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'view' AND value > 280)),
gone AS (SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM embeddings) AS job_id FROM events WHERE event_type IN ('error', 'signup')),
met AS (SELECT a.request_id, a.sort_type, a.off, a.guest, b.job_id, b.posted_date AS posted, round(1 - {PAIR}, 9) AS d,
  coalesce((want IS NULL OR b.country = want) AND (NOT lev OR b.experience IN ('Senior-level', 'Mid-level')), false) AS ok
  FROM req a CROSS JOIN live b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = a.user_id AND g.job_id = b.job_id)),
scored AS (SELECT * FROM met WHERE NOT guest),
dated AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY posted DESC NULLS FIRST, job_id) AS rank FROM met WHERE guest AND ok),
fil AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, job_id) AS rank, 0 AS tier FROM scored WHERE ok),
unf AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, job_id) AS rank, 1 AS tier FROM scored)
"""
MATCH_KEY = f"""CASE sort_type WHEN 'date' THEN {DATE_KEY.format(score='score', thr='50', posted='posted')}
  WHEN 'matching_score' THEN coalesce(score, 0) ELSE {RECOMMENDED.format(score='score', thr='50', posted='posted')} END"""


@query("match_user_jobs", f"""WITH {MATCH},
  first AS (SELECT * FROM fil WHERE rank <= 1000), counts AS (SELECT request_id, count(*) AS n FROM first GROUP BY 1),
  mixed AS (SELECT * FROM first UNION ALL SELECT u.* FROM unf u LEFT JOIN counts c ON c.request_id = u.request_id
    WHERE u.rank <= 1000 AND coalesce(n, 0) < 1000 AND (u.request_id, u.job_id) NOT IN (SELECT request_id, job_id FROM first)),
  calibrated AS (SELECT *, {SIGMOID_SQL.format(d='d')} AS score FROM mixed),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, {MATCH_KEY} DESC, rank, job_id) AS position FROM calibrated)
  SELECT s.request_id, position, job_id, round(d, 6) AS distance, score, rank, tier,
  CASE WHEN coalesce(n, 0) < 1000 THEN 1000 ELSE 2000 END AS total_count FROM sorted s LEFT JOIN counts c ON c.request_id = s.request_id
  WHERE position > off AND position <= off + 25
  UNION ALL SELECT request_id, rank, job_id, NULL, NULL, rank, 0, 2000 FROM dated WHERE rank > off AND rank <= off + 25""")
def _(spark, sf):
    page = match_user_jobs(
        match_requests(spark, sf), match_jobs(spark, sf), *match_exclusions(spark, sf), t.as_of())
    return page.withColumn("distance", F.round("distance", 6))


@query("search_by_date_requests", f"""WITH {MATCH.replace("vec_id % 37 = 5 AS guest", "true AS guest")} SELECT request_id, job_id, strftime(posted, '%Y-%m-%d') AS posted, rank
  FROM dated WHERE rank > off AND rank <= off + 25""")
def _(spark, sf):
    """All requests answered by date."""
    found = search_by_date_requests(match_requests(spark, sf), match_jobs(spark, sf), *match_exclusions(spark, sf))
    return found.select("request_id", "job_id", F.date_format("posted_date", "yyyy-MM-dd").alias("posted"), "rank")


@query("match_user_jobs_filtered", f"""WITH {MATCH} SELECT request_id, job_id, round(d, 6) AS distance, {SIGMOID_SQL.format(d='d')} AS score, rank FROM fil WHERE rank <= 50""")
def _(spark, sf):
    """The ranked candidates before sorting and paging."""
    ranked = ranked_matches(match_requests(spark, sf), match_jobs(spark, sf), *match_exclusions(spark, sf), k=50)
    return ranked.withColumn("distance", F.round("distance", 6))


@query("stale_match_keys", f"""WITH m AS (SELECT o_custkey AS request_id, o_custkey % 150 AS user_id, l_partkey % (SELECT count(*) FROM embeddings) AS job_id, max(o_orderdate) OVER (PARTITION BY o_custkey) AS made
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  marked AS (SELECT *, (user_id, job_id) NOT IN (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type IN ('error', 'signup'))
    AND job_id NOT IN (SELECT event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'view' AND value > 100) AS alive FROM m)
  SELECT request_id, count(*) AS stored, CAST(sum(CASE WHEN alive THEN 1 ELSE 0 END) AS BIGINT) AS survivors,
  max(made) < TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 300 SECOND OR (sum(CASE WHEN alive THEN 1 ELSE 0 END) < 25 AND count(*) >= 50) AS recompute FROM marked GROUP BY 1""")
def _(spark, sf):
    """Customers' lines as stored matches, the last order as the time of the result."""
    orders, lines = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    stored = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("request_id"), (F.col("o_custkey") % 150).alias("user_id"),
        (F.col("l_partkey") % t.n_vectors(spark, sf)).alias("job_id"), F.col("o_orderdate").alias("created"))
    cooled = t.table(spark, sf, "events").where("event_type = 'view' AND value > 100").select((F.col("event_id") % t.n_vectors(spark, sf)).alias("job_id"))
    now = F.lit("2000-06-01 00:00:00").cast("timestamp_ntz")
    return ranking.stale_match_keys(
        stored, t.event_pairs(spark, sf, "error"), t.event_pairs(spark, sf, "signup"), cooled, now)


# --- fusion ---------------------------------------------------------------------------------
def fused_candidates(spark, sf):
    """Order lines as candidates of their supplier with three scores."""
    return t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("item_id")).agg(
        (F.max("l_extendedprice") / 100000).alias("bi_score"),
        F.max(F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 50)).alias("cross_score"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 10)).alias("skill_score"))


FUSED = """c AS (SELECT l_suppkey AS query_id, l_orderkey AS item_id, max(l_extendedprice) / 100000 AS bi,
  max(CASE WHEN l_returnflag <> 'N' THEN l_quantity / 50 END) AS cr, max(CASE WHEN l_linestatus = 'F' THEN l_discount * 10 END) AS sk FROM lineitem GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bi DESC, item_id) AS r FROM c) WHERE r <= 100)"""


@query("fuse_scores", f"""WITH {FUSED}, f AS (SELECT *, round(CASE WHEN cr IS NOT NULL THEN bi * 0.3::DOUBLE + cr * 0.5::DOUBLE ELSE bi END + coalesce(sk * 0.2::DOUBLE, 0), 9) AS x FROM top)
  SELECT query_id, item_id, round(x, 8) AS final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, item_id) AS rank FROM f) WHERE rank <= 25""")
def _(spark, sf):
    fused = ranking.fuse_scores(fused_candidates(spark, sf))
    return rounded(fused.select("query_id", "item_id", "final_score", "rank"), digits=8)


@query("rerank_two_stage", f"""WITH {FUSED}, f AS (SELECT *, round(coalesce(cr, 0) * 0.7::DOUBLE + bi * 0.3::DOUBLE, 9) AS x FROM top)
  SELECT query_id, item_id, round(x, 8) AS final_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, item_id) AS rank FROM f) WHERE rank <= 25""")
def _(spark, sf):
    rows = fused_candidates(spark, sf).fillna(0.0, ["cross_score"])
    return rounded(ranking.rerank_two_stage(rows).select("query_id", "item_id", "final_score", "rank"), digits=8)


@query("biencoder_scores", """SELECT l_orderkey, l_partkey % (SELECT count(*) FROM embeddings) AS item, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS bi_score
  FROM lineitem JOIN embeddings a ON a.vec_id = l_orderkey % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = l_partkey % (SELECT count(*) FROM embeddings)""")
def _(spark, sf):
    e = t.table(spark, sf, "embeddings")
    pairs = t.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_orderkey") % t.n_vectors(spark, sf)).alias("q"), (F.col("l_partkey") % t.n_vectors(spark, sf)).alias("item"))
    scored = ranking.score_pairs(
        pairs, e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("iv")),
        query_id="q", item_id="item", query_vector="qv", item_vector="iv")
    return rounded(scored.select("l_orderkey", "item", "bi_score"))


@query("skill_graph_scores", """WITH s AS (SELECT l_orderkey AS id, list_distinct(list(l_returnflag || l_linestatus)) AS k FROM lineitem GROUP BY 1)
  SELECT a.id, round(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 6) AS skill_score FROM s a JOIN s b ON b.id = a.id + 1""")
def _(spark, sf):
    sets = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("f"))
    nxt = sets.select((F.col("id") - 1).alias("id"), F.col("f").alias("g"))
    return rounded(overlap(sets.join(nxt, "id"), "f", "g").select("id", "skill_score"))


@query("encode_text")
def _(spark, sf):
    coded = ranking.encode_text(t.table(spark, sf, "documents"), "text")
    return coded.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))


@query("score_pairs", r"""SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS cross_score
  FROM (SELECT x.conv_id, x.turn, regexp_extract_all(lower(regexp_replace(x.text, '[^\x00-\x7F]', '~', 'g')), '\w+') AS a,
  regexp_extract_all(lower(regexp_replace(y.text, '[^\x00-\x7F]', '~', 'g')), '\w+') AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)""")
def _(spark, sf):
    turns = t.table(spark, sf, "conversations").select("conv_id", "turn", t.ascii_text().alias("text"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return rounded(ranking.score_text_pairs(turns.join(nxt, ["conv_id", "turn"]), "text", "answer").select("conv_id", "turn", "cross_score"))


@query("multi_stage_matches")
def _(spark, sf):
    """Encoded benchmark passages against encoded documents, with fused scores."""
    from pairwright.operators.skills import extract_skills, skill_sets

    docs = t.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), "text")
    path = scratch_path(spark, "encoded")
    ranking.encode_text(docs, "text", "job_vector").write.parquet(path)
    jobs = spark.read.parquet(path)
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("resume_id"), "text")
    resumes = ranking.encode_text(asked, "text", "resume_vector")
    resume_skills = skill_sets(extract_skills(asked, doc_id="resume_id"), "resume_id")

    def job_skills(retrieved):
        return skill_sets(extract_skills(docs.join(retrieved, "job_id", "left_semi"), doc_id="job_id"), "job_id")

    fused = multi_stage_matches(resumes, jobs, resume_skills, job_skills)
    return fused.select("resume_id", "job_id", "bi_score", "cross_score", "skill_score", "final_score", "rank")


