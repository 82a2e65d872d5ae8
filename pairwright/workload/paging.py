"""Sorting and paging over whole tables.

Suppliers are the requests, their lines the ranked matches (dearest first).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators import paging
from pairwright.operators.skew import top_k
from pairwright.workload import tables as t
from pairwright.workload.registry import query

AS_OF_SQL = "TIMESTAMP '2003-01-01 00:00:00'"
AGE = f"epoch({AS_OF_SQL} - {{posted}})"
DAYS = f"floor(epoch({AS_OF_SQL} - {{posted}}) / 86400)"
RECOMMENDED = ("CASE WHEN coalesce({score}, 0) < {thr} THEN coalesce({score}, 0) - 1440 "
               f"ELSE coalesce({{score}}, 0) + 100 * (1 - power(1.03::DOUBLE, {DAYS})) END")
DATE_KEY = f"CASE WHEN {{score}} IS NULL OR {{score}} >= {{thr}} THEN -{AGE} ELSE {{score}} - 7776000 END"


@query("search_by_date", """SELECT o_orderkey AS job_id, strftime(posted, '%Y-%m-%d') AS posted FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL ELSE o_orderdate END AS posted FROM orders)
  ORDER BY posted DESC NULLS FIRST, o_orderkey LIMIT 1000 OFFSET 50""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr(
        "CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN NULL ELSE o_orderdate END").alias("posted_date"))
    found = paging.search_by_date(rows, limit=fv.WINDOW_ROWS, offset=50)
    return found.select("job_id", t.day("posted_date").alias("posted"))


def scored_orders(spark, sf):
    """Orders with a score (null for some), a date and a prior rank."""
    return t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("rank"),
        F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("score"),
        F.col("o_orderdate").alias("posted_date"))


SCORED = """scored AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 5000) END AS score, o_orderdate AS posted FROM orders)"""


def sort_query(name, key_sql, key):
    @query(name, f"WITH {SCORED} SELECT job_id, row_number() OVER (ORDER BY {key_sql} DESC, job_id) AS position FROM scored")
    def _(spark, sf):
        return paging.sort_all(scored_orders(spark, sf), key(), "rank").select("job_id", "position")


sort_query("sort_matching_score", "coalesce(score, 0)", lambda: paging.score_key(F.col("score")))
sort_query("sort_date", DATE_KEY.format(score="score", thr="50", posted="posted"),
           lambda: paging.date_key(F.col("score"), F.col("posted_date"), t.as_of(), F.lit(50.0)))
sort_query("sort_recommended", RECOMMENDED.format(score="score", thr="50", posted="posted"),
           lambda: paging.recommended_key(F.col("score"), F.col("posted_date"), t.as_of(), F.lit(50.0)))


@query("score_threshold", "SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 6 = 0 THEN 0.0::DOUBLE ELSE 50.0 END AS threshold FROM supplier")
def _(spark, sf):
    return t.requests(spark, sf).select("request_id", paging.score_threshold(F.col("fields")).alias("threshold"))


def page_requests(spark, sf):
    key = F.col("n_nationkey")
    return t.table(spark, sf, "nation").select(
        key.cast("bigint").alias("request_id"), ((key * 109) % 2399).cast("int").alias("offset"),
        F.element_at(F.array(F.lit("recommended"), F.lit("date"), F.lit("matching_score")), (key % 3 + 1)).alias("sort_type"))


def lines_by_nation(spark, sf, k=3000, cheap=False):
    """Lines of a nation's suppliers, ranked by price; only cheap-quantity lines if asked."""
    lines, supplier = t.table(spark, sf, "lineitem"), t.table(spark, sf, "supplier")
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    if cheap:
        rows = rows.where("l_quantity <= 12")
    best = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("request_id"), F.col("l_orderkey").alias("job_id")).agg(
        F.max("l_extendedprice").alias("price"), F.max(F.round(F.col("l_discount") * 1000)).alias("score"),
        F.max("l_shipdate").alias("posted_date"))
    return top_k(best, ["request_id"], [F.desc("price"), F.asc("job_id")], k)


def ranked_sql(name, where=""):
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY price DESC, job_id) AS rank FROM
  (SELECT s_nationkey AS request_id, l_orderkey AS job_id, max(l_extendedprice) AS price, max(round(l_discount * 1000)) AS score, max(l_shipdate) AS posted
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY 1, 2))"""


PAGES = f"""req AS (SELECT n_nationkey AS request_id, (n_nationkey * 109) % 2399 AS off, ['recommended', 'date', 'matching_score'][n_nationkey % 3 + 1] AS sort_type FROM nation),
win AS (SELECT *, floor(CASE WHEN off > 2000 THEN 0 ELSE off END / 1000) AS w1,
  CASE WHEN off % 1000 > (off + 25) % 1000 THEN floor(CASE WHEN off + 1000 > 2000 THEN 0 ELSE off + 1000 END / 1000) END AS w2 FROM req)"""
KEY = f"""CASE sort_type WHEN 'date' THEN {DATE_KEY.format(score='score', thr='50', posted='posted')}
  WHEN 'matching_score' THEN coalesce(score, 0) ELSE {RECOMMENDED.format(score='score', thr='50', posted='posted')} END"""


def page_key():
    return paging.sort_key(F.col("sort_type"), F.col("score"), F.col("posted_date"), t.as_of(), F.lit(50.0))


@query("page_window", f"""WITH {ranked_sql('ranked')}, {PAGES},
  loaded AS (SELECT r.*, w.off, w.sort_type FROM ranked r JOIN win w ON r.request_id = w.request_id AND floor((rank - 1) / 1000) IN (w1, coalesce(w2, w1))),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {KEY} DESC, rank, job_id) AS position FROM loaded)
  SELECT request_id, job_id, position FROM sorted WHERE position > off % 1000 AND position <= off % 1000 + 25""")
def _(spark, sf):
    requests = page_requests(spark, sf)
    ranked = lines_by_nation(spark, sf).join(requests.select("request_id", "sort_type"), "request_id")
    return paging.page_window(ranked, requests, page_key()).select("request_id", "job_id", "position")


@query("fallback_fill", f"""WITH {ranked_sql('unf')}, {ranked_sql('fil', 'WHERE l_quantity <= 12')}, {PAGES},
  loaded AS (SELECT r.*, w.off, w.sort_type FROM fil r JOIN win w ON r.request_id = w.request_id AND floor((rank - 1) / 1000) IN (w1, coalesce(w2, w1))),
  need AS (SELECT req.request_id, off, sort_type, coalesce(n, 0) < 1000 AND off < 1000 AS fill FROM req LEFT JOIN (SELECT request_id, count(*) AS n FROM loaded GROUP BY 1) c ON c.request_id = req.request_id),
  mixed AS (SELECT request_id, job_id, score, posted, rank, sort_type, 0 AS tier FROM loaded UNION ALL
    SELECT u.request_id, u.job_id, u.score, u.posted, u.rank, n.sort_type, 1 FROM unf u JOIN need n ON n.request_id = u.request_id AND n.fill WHERE u.rank <= 1000
    AND (u.request_id, u.job_id) NOT IN (SELECT request_id, job_id FROM loaded)),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, {KEY} DESC, rank, job_id) AS position FROM mixed)
  SELECT s.request_id, job_id, position, tier, CASE WHEN fill THEN 1000 ELSE 2000 END AS total_count FROM sorted s JOIN need n ON n.request_id = s.request_id""")
def _(spark, sf):
    requests = page_requests(spark, sf)
    kinds = requests.select("request_id", "sort_type")
    loaded = paging.in_windows(lines_by_nation(spark, sf, cheap=True), requests).drop("offset").join(kinds, "request_id")
    spare = lines_by_nation(spark, sf, 1000).join(kinds, "request_id")
    filled = paging.fallback_fill(loaded, spare, requests, page_key())
    return filled.select("request_id", "job_id", "position", "tier", "total_count")


@query("topk_per_query", """SELECT l_suppkey AS query_id, l_orderkey AS item_id, price AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY price DESC, l_orderkey) AS rank
  FROM (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10""")
def _(spark, sf):
    rows = t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("item_id")).agg(
        F.max("l_extendedprice").alias("score"))
    return paging.topk_per_query(rows, 10, "score")


@query("top_matches_internal", f"""WITH {ranked_sql('ranked')}, sorted AS (SELECT *, row_number() OVER (PARTITION BY request_id
  ORDER BY {RECOMMENDED.format(score='score', thr='50', posted='posted')} DESC, rank, job_id) AS position FROM ranked WHERE rank <= 1000)
  SELECT request_id, job_id, position FROM sorted WHERE position <= 10""")
def _(spark, sf):
    requests = page_requests(spark, sf).withColumn("offset", F.lit(0)).withColumn("sort_type", F.lit("recommended"))
    ranked = lines_by_nation(spark, sf).join(requests.select("request_id", "sort_type"), "request_id")
    page = paging.page_window(ranked, requests, page_key())
    return paging.top_matches_internal(page).select("request_id", "job_id", "position")


@query("rejection_list", "SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS since FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    rejected = t.event_pairs(spark, sf, "signup").withColumnRenamed("ts", "timestamp")
    return paging.rejection_list(rejected).select("user_id", "job_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("since"))


