"""Explanations: suppliers as people, orders as jobs, return and status flags as skills."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import explain
from pairwright.operators import graph as graph_ops
from pairwright.operators.skills import skill_overlap as overlaps
from pairwright.plans.retrieval import explained_matches
from pairwright.session import cut_lineage
from pairwright.workload import tables as t
from pairwright.workload.registry import query
from pairwright.workload.rollups import rounded
from pairwright.workload.sources import GRAPH, part_graph


def matches(spark, sf):
    """Pairs of neighbouring orders with part sets, levels, years and places."""
    orders, lines = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    customers, nations = t.table(spark, sf, "customer"), t.table(spark, sf, "nation")
    sets = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey")))).alias("s"))
    level = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior-level' WHEN '2-HIGH' THEN 'VP' WHEN '3-MEDIUM' THEN 'junior' WHEN '5-LOW' THEN '' END")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "o_orderkey", level.alias("level"), (F.col("o_orderkey") % 9).cast("int").alias("years"),
        F.when(F.col("n_nationkey") % 4 == 0, "Palo Alto, CA").when(F.col("n_nationkey") % 4 == 1, "OAKLAND")
        .when(F.col("n_nationkey") % 8 == 2, "").otherwise(F.col("n_name")).alias("place"))
    jobs = placed.join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    people = jobs.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("level").alias("resume_level"),
                         F.col("years").alias("resume_years"), F.col("place").alias("resume_location"), F.col("s").alias("resume_skills"))
    empty = F.array().cast("array<string>")
    return jobs.join(people, "o_orderkey").select(
        (F.col("o_orderkey") + 1).alias("resume_id"), F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("job "), F.col("o_orderkey")).alias("job_title"),
        (F.col("o_orderkey") % 100 / 100).alias("overall_score"),
        F.coalesce("resume_skills", empty).alias("resume_skills"), F.coalesce("s", empty).alias("job_skills"),
        "resume_level", "resume_years", "resume_location", F.col("level").alias("job_level"),
        F.col("years").alias("job_years"), F.col("place").alias("job_location"),
        (F.col("o_orderkey") % 6 == 0).alias("is_remote"))


MATCHES = """
sets AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT 'p' || l_partkey)) AS s FROM lineitem GROUP BY 1),
placed AS (SELECT o_orderkey AS o, CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior-level' WHEN '2-HIGH' THEN 'VP' WHEN '3-MEDIUM' THEN 'junior' WHEN '5-LOW' THEN '' END AS level,
  CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 1 ELSE 2 END AS num,
  o_orderkey % 9 AS years, CASE WHEN n_nationkey % 4 = 0 THEN 'Palo Alto, CA' WHEN n_nationkey % 4 = 1 THEN 'OAKLAND' WHEN n_nationkey % 8 = 2 THEN '' ELSE n_name END AS place,
  coalesce(s, []) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sets ON sets.o = o_orderkey),
m AS (SELECT a.o AS job_id, a.o + 1 AS resume_id, a.level AS jl, a.num AS jn, a.years AS jy, a.place AS jp, a.s AS js, b.level AS rl, b.num AS rn, b.years AS ry, b.place AS rp, b.s AS rs,
  a.o % 6 = 0 AS remote, (a.o % 100) / 100 AS overall FROM placed a JOIN placed b ON b.o = a.o + 1)
"""
RELATED = f"""{GRAPH},
d AS (SELECT src, dst, arg_min(weight, seq) AS w FROM edges GROUP BY 1, 2),
two AS (SELECT a.src, b.dst, arg_min(a.weight * b.weight * 0.5::DOUBLE, a.seq::HUGEINT * 100000000000::HUGEINT + b.seq) AS w FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src <> b.dst GROUP BY 1, 2),
sim AS (SELECT coalesce(d.src, two.src) AS x, coalesce(d.dst, two.dst) AS y, coalesce(d.w, two.w) AS w FROM d FULL JOIN two ON two.src = d.src AND two.dst = d.dst),
{MATCHES},
rr AS (SELECT job_id, x, y, w, row_number() OVER (PARTITION BY job_id ORDER BY w DESC, x, y) AS r FROM (SELECT job_id, rs, js, unnest(rs) AS a FROM m) JOIN sim ON x = a
  WHERE w > 0.3 AND list_contains(js, y) AND NOT list_contains(js, x) AND NOT list_contains(rs, y)),
rel AS (SELECT job_id, sum(w) AS w, string_agg(x || '>' || y, ',' ORDER BY r) AS names FROM rr WHERE r <= 5 GROUP BY 1),
sk AS (SELECT m.*, names, coalesce(rel.w, 0) AS w, list_sort(list_intersect(rs, js)) AS matched, list_sort(list_filter(js, lambda v: NOT list_contains(rs, v))) AS missing,
  list_sort(list_filter(rs, lambda v: NOT list_contains(js, v)))[1:5] AS bonus,
  CASE WHEN len(js) > 0 THEN least(1, len(list_intersect(rs, js)) / len(js) + coalesce(rel.w, 0) * 0.5 / len(js)) WHEN len(rs) > 0 THEN 1 ELSE 0.5 END AS score FROM m LEFT JOIN rel ON rel.job_id = m.job_id)
"""
STRENGTH = "CASE WHEN {s} >= 0.8 THEN 'strong' WHEN {s} >= 0.5 THEN 'moderate' WHEN {s} >= 0.2 THEN 'weak' ELSE 'missing' END"
EXP = f"""ex AS (SELECT job_id, coalesce(jl, '') <> '' OR jy <> 0 AS asked, coalesce(nullif(jl, ''), 'unknown') AS jl2, coalesce(nullif(rl, ''), 'unknown') AS rl2,
  CASE WHEN rn >= jn THEN 1.0 WHEN rn = jn - 1 THEN 0.7 ELSE 0.4 END AS ls, ry, jy FROM m),
exs AS (SELECT *, CASE WHEN ry <> 0 AND jy <> 0 THEN (ls + CASE WHEN ry >= jy THEN 1.0 WHEN ry >= jy * 0.7 THEN 0.8 ELSE 0.5 END) / 2 ELSE ls END AS es FROM ex)"""
LOC = """lo AS (SELECT job_id, jp, coalesce(nullif(rp, ''), 'Unknown') AS rp2, remote,
  CASE WHEN remote OR lower(coalesce(nullif(rp, ''), 'Unknown')) = lower(jp) THEN 1.0 WHEN lower(rp) IN ('palo alto, ca', 'oakland') AND lower(jp) IN ('palo alto, ca', 'oakland') THEN 0.8 ELSE 0.3 END AS ls FROM m WHERE jp <> '')"""


@query("skill_overlap", f"""WITH {MATCHES} SELECT job_id, array_to_string(list_sort(list_intersect(rs, js)), ',') AS matched,
  CAST(len(list_filter(rs, lambda v: NOT list_contains(js, v))) AS BIGINT) AS first_only, CAST(len(list_filter(js, lambda v: NOT list_contains(rs, v))) AS BIGINT) AS second_only,
  round(CASE WHEN len(list_concat(rs, js)) = 0 THEN 0 ELSE len(list_intersect(rs, js)) / len(list_distinct(list_concat(rs, js))) END, 6) AS jaccard_similarity,
  round(CASE WHEN len(js) = 0 THEN 0 ELSE len(list_intersect(rs, js)) / len(js) END, 6) AS recall, round(CASE WHEN len(rs) = 0 THEN 0 ELSE len(list_intersect(rs, js)) / len(rs) END, 6) AS precision FROM m""")
def _(spark, sf):
    rows = overlaps(matches(spark, sf), "resume_skills", "job_skills")
    return rounded(rows.select(
        "job_id", F.array_join("matched", ",").alias("matched"), F.size("only_in_first").cast("bigint").alias("first_only"),
        F.size("only_in_second").cast("bigint").alias("second_only"), "jaccard_similarity", "recall", "precision"))


def with_related(spark, sf):
    parts, relations = part_graph(spark, sf)
    rows, relations = cut_lineage(matches(spark, sf)), cut_lineage(relations)
    similar = cut_lineage(graph_ops.match_similarities(rows, parts, graph_ops.skill_edges(relations)))
    related = explain.related_skill_lists(rows, similar)
    return rows.join(related, ["resume_id", "job_id"], "left"), similar


@query("explain_skills", f"""WITH {RELATED} SELECT job_id, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, array_to_string(bonus, ',') AS bonus,
  coalesce(names, '') AS related, round(score, 6) AS match_score, {STRENGTH.format(s='score')} AS strength FROM sk""")
def _(spark, sf):
    rows, _ = with_related(spark, sf)
    part = F.col("skill_explanation")
    pairs = F.array_join(F.transform(part["related_skills"], lambda r: F.concat(r["skill1"], F.lit(">"), r["skill2"])), ",")
    return rounded(explain.explain_skills(rows).select(
        "job_id", F.array_join(part["matched_skills"], ",").alias("matched"), F.array_join(part["missing_skills"], ",").alias("missing"),
        F.array_join(part["bonus_skills"], ",").alias("bonus"), pairs.alias("related"), part["match_score"].alias("match_score"), part["strength"].alias("strength")))


@query("explain_experience", f"""WITH {MATCHES}, {EXP} SELECT job_id, CASE WHEN asked THEN jl2 END AS required_level, CASE WHEN asked THEN rl2 END AS candidate_level,
  CASE WHEN asked THEN round(es, 6) END AS match_score, CASE WHEN asked THEN {STRENGTH.format(s='es')} END AS strength FROM exs""")
def _(spark, sf):
    part = F.col("experience_explanation")
    return rounded(explain.explain_experience(matches(spark, sf)).select(
        "job_id", part["required_level"].alias("required_level"), part["candidate_level"].alias("candidate_level"),
        part["match_score"].alias("match_score"), part["strength"].alias("strength")))


@query("explain_location", f"""WITH {MATCHES}, {LOC} SELECT m.job_id, rp2 AS candidate_location, ls::DOUBLE AS match_score,
  CASE WHEN ls = 1 THEN 'strong' WHEN ls = 0.8 THEN 'moderate' WHEN ls = 0.3 THEN 'weak' END AS strength FROM m LEFT JOIN lo ON lo.job_id = m.job_id""")
def _(spark, sf):
    part = F.col("location_explanation")
    return explain.explain_location(matches(spark, sf)).select(
        "job_id", part["candidate_location"].alias("candidate_location"), part["match_score"].alias("match_score"), part["strength"].alias("strength"))


SUMMARY = f"""WITH {RELATED}, {EXP}, {LOC}, j AS (SELECT sk.*, asked, es, jl2, rl2, lo.ls, lo.jp AS ljp FROM sk JOIN exs ON exs.job_id = sk.job_id LEFT JOIN lo ON lo.job_id = sk.job_id)
  SELECT job_id, {STRENGTH.format(s='overall')} AS overall_strength,
  CASE WHEN overall >= 0.8 THEN 'Strong match with aligned skills and qualifications.' WHEN overall >= 0.6 THEN 'Good match with some areas for consideration.'
    WHEN overall >= 0.4 THEN 'Partial match - review specific requirements carefully.' ELSE 'Limited match - significant gaps in requirements.' END AS summary,
  concat_ws('; ', CASE WHEN len(matched) > 0 THEN 'Matches ' || len(matched) || ' required skills: ' || array_to_string(matched[1:3], ', ') END,
    CASE WHEN len(bonus) > 0 THEN 'Brings additional skills: ' || array_to_string(bonus[1:3], ', ') END,
    CASE WHEN asked AND es >= 0.8 THEN 'Experience level (' || rl2 || ') meets requirements' END,
    CASE WHEN ljp IS NULL THEN NULL WHEN remote THEN 'Remote work available' WHEN ls = 1 THEN 'Location matches: ' || ljp END) AS highlights,
  concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'Missing ' || len(missing) || ' required skills: ' || array_to_string(missing[1:3], ', ') END,
    CASE WHEN asked AND es < 0.5 THEN 'Experience level may be below requirement (' || jl2 || ')' END,
    CASE WHEN NOT remote AND ls = 0.3 THEN 'Location mismatch: job in ' || ljp END) AS concerns FROM j"""


def shown(df):
    return df.select("job_id", "overall_strength", "summary", F.concat_ws("; ", "highlights").alias("highlights"), F.concat_ws("; ", "concerns").alias("concerns"))


@query("explain_summary", SUMMARY)
def _(spark, sf):
    rows, _ = with_related(spark, sf)
    return shown(explain.explain_summary(explain.explain_location(explain.explain_experience(explain.explain_skills(rows)))))


@query("explain_batch", SUMMARY)
def _(spark, sf):
    """The same from a fused result table and two metadata tables."""
    rows, similar = with_related(spark, sf)
    fused = rows.select("resume_id", "job_id", F.col("overall_score").alias("final_score"), "resume_skills", "job_skills")
    people = rows.select("resume_id", "resume_level", "resume_years", "resume_location")
    jobs = rows.select("job_id", "job_title", "job_level", "job_years", "job_location", "is_remote")
    return shown(explained_matches(fused, people, jobs, similar))
