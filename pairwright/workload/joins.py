"""Filters, joins, set operations and table maintenance over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions.geo import geo_distance as metres_between
from pairwright.operators import filters, geo, joins, maintenance
from pairwright.operators import graph as graph_ops
from pairwright.operators.skew import top_k
from pairwright.workload import tables as t
from pairwright.workload.columns import ASKED_SQL, UUID_SQL, asked_uuid, uuid
from pairwright.workload.registry import query
from pairwright.workload.sources import GRAPH, logo_map, part_graph


def request_filter(*columns):
    """Requests with only the given filter columns set."""
    def build(spark, sf):
        rows = t.requests(spark, sf)
        empty = [c for c in ("locations", "keywords", "experience", "company", "is_remote_only", "fields")
                 if c not in columns]
        return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in empty})

    return build


def batch_filter(name, test, *columns, bridge=False):
    @query(name, f"""WITH {t.STAR}, {t.REQUESTS} SELECT r.request_id, count(*) AS jobs, CAST(sum(f.job_id) AS BIGINT) AS job_sum
  FROM requests r CROSS JOIN flat f WHERE {test} GROUP BY r.request_id""")
    def _(spark, sf):
        asked = request_filter(*columns)(spark, sf)
        links = t.field_jobs(spark, sf) if bridge else None
        return filters.eligible_counts(asked, t.flat_jobs(spark, sf), links)


batch_filter("filter_location", t.LOCATION_TEST, "locations")
batch_filter("filter_experience", t.EXPERIENCE_TEST, "experience")
batch_filter("filter_keyword_phrase", t.PHRASE_TEST, "keywords")
batch_filter("filter_company", t.COMPANY_TEST, "company")
batch_filter("filter_remote_only", t.REMOTE_TEST, "is_remote_only")
batch_filter("filter_fields", t.FIELDS_TEST, "fields", bridge=True)
batch_filter(
    "filter_all_together",
    " AND ".join([t.LOCATION_TEST, t.EXPERIENCE_TEST, t.PHRASE_TEST, t.COMPANY_TEST, t.REMOTE_TEST, t.FIELDS_TEST]),
    "locations", "keywords", "experience", "company", "is_remote_only", "fields", bridge=True,
)


@query("filter_single_request", f"""WITH {t.STAR} SELECT job_id FROM flat WHERE
  ((country = 'United States' AND city IN ('NATION_6', 'remote')) OR coalesce(2*6371008.8*asin(sqrt(
    power(sin((radians(latitude)-radians(10.0))/2),2)+cos(radians(10.0))*cos(radians(latitude))
    *power(sin((radians(longitude)-radians(20.0))/2),2))) <= 5000000 OR city = 'remote', false))
  AND experience IN ('Senior-level') AND (title ILIKE '%urg_nt%' OR description ILIKE '%urg_nt%')
  AND company_name ILIKE 'customer#%'""")
def _(spark, sf):
    """One request's filters as plain columns, pushed to the scans by Catalyst."""
    wanted = [
        {"country": "USA", "city": "NATION_6"},
        {"latitude": 10.0, "longitude": 20.0, "radius_km": 5000.0, "city": "ignored"},
    ]
    col = F.col
    return t.flat_jobs(spark, sf).where(
        filters.location_matches(wanted, col("city"), col("country"), col("latitude"), col("longitude"))
        & filters.experience_in(col("experience"), ["Senior-level", "Boss"])
        & filters.phrase_matches(col("title"), col("description"), F.lit("urg_nt"))
        & filters.company_matches(col("company_name"), F.lit("customer#%"))
    ).select("job_id")


@query("filter_has_embedding", "SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id")
def _(spark, sf):
    docs, vectors = t.table(spark, sf, "documents"), t.table(spark, sf, "embeddings")
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return joined.where(filters.has_embedding()).select("doc_id")


@query("filter_similarity_band", "SELECT event_id, value FROM events WHERE value / 100 BETWEEN 0.3 AND 0.9")
def _(spark, sf):
    rows = t.table(spark, sf, "events").withColumn("similarity", F.col("value") / 100)
    return filters.filter_similarity_band(rows).select("event_id", "value")


@query("filter_required_fields", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderkey").cast("string")).alias("job_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("title"),
    )
    return filters.filter_required_fields(rows).select(F.col("job_id").cast("bigint").alias("job_id"))


@query("filter_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 30 DAY")
def _(spark, sf):
    now = F.lit("2024-02-09 12:00:00").cast("timestamp_ntz")
    return filters.filter_retention(t.table(spark, sf, "events"), now, "ts").select("event_id")


# --- joins -----------------------------------------------------------------------------
@query("join_star_left", f"""WITH {t.STAR} SELECT country, city, count(*) AS jobs, count(company_name) AS named,
  count(logo) AS logos FROM flat GROUP BY country, city""")
def _(spark, sf):
    return t.flat_jobs(spark, sf).groupBy("country", "city").agg(
        F.count(F.lit(1)).alias("jobs"), F.count("company_name").alias("named"), F.count("logo").alias("logos")
    )


@query("join_semi_fields", """SELECT o_orderkey AS job_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part
  ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 7)""")
def _(spark, sf):
    wanted = t.table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("field_id"))
    return joins.join_semi_fields(t.jobs(spark, sf), t.field_jobs(spark, sf), wanted).select("job_id")


def order_pairs(spark, sf):
    """Customers with the parts they ordered, as (user, job) pairs."""
    orders, lines = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("job_id")
    )


PAIRS = "pairs AS (SELECT o_custkey AS user_id, l_partkey AS job_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("join_anti_blacklist", f"""WITH {PAIRS} SELECT user_id, job_id FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE event_type = 'error' AND e.user_id = p.user_id AND e.event_id % (SELECT count(*) FROM embeddings) = p.job_id)
  AND job_id NOT IN (SELECT event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'view' AND value > 100)""")
def _(spark, sf):
    cooled = t.table(spark, sf, "events").where("event_type = 'view' AND value > 100").select(
        (F.col("event_id") % t.n_vectors(spark, sf)).alias("job_id"))
    return joins.join_anti_blacklist(order_pairs(spark, sf), t.event_pairs(spark, sf, "error"), cooled)


@query("join_anti_rejected", f"""WITH {PAIRS} SELECT user_id, job_id FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM events e WHERE event_type = 'signup' AND e.user_id = p.user_id AND e.event_id % (SELECT count(*) FROM embeddings) = p.job_id)""")
def _(spark, sf):
    return joins.join_anti_rejected(order_pairs(spark, sf), t.event_pairs(spark, sf, "signup"))


@query("join_fields_fanout", """SELECT o_orderkey AS job_id, p_brand AS root_field, p_type AS sub_field
  FROM (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3)
  LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def _(spark, sf):
    """The three dearest orders of every customer, then their fields."""
    best = top_k(t.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    matches = best.select(F.col("o_orderkey").alias("job_id"))
    fanned = joins.join_fields_fanout(matches, t.field_jobs(spark, sf), t.fields(spark, sf))
    return fanned.select("job_id", "root_field", "sub_field")


def supplier_points(spark, sf):
    key = F.col("s_suppkey")
    return t.table(spark, sf, "supplier").select(
        key.alias("request_id"), ((key * 37) % 181 - 90).cast("double").alias("latitude"),
        ((key * 73) % 361 - 180).cast("double").alias("longitude"),
        F.element_at(F.array(F.lit(50.0), F.lit(300.0), F.lit(1200.0), F.lit(4000.0)),
                     (key % 4 + 1).cast("int")).alias("radius_km"),
    )


def customer_points(spark, sf):
    key = F.col("c_custkey")
    return t.table(spark, sf, "customer").select(
        key.alias("place_id"),
        F.when(key % 17 != 0, (key * 7919) % 18001 / 100.0 - 90.0).alias("place_latitude"),
        ((key * 104729) % 36001 / 100.0 - 180.0).alias("place_longitude"),
    )


POINTS = """
asked AS (SELECT s_suppkey AS request_id, CAST((s_suppkey * 37) % 181 - 90 AS DOUBLE) AS lat,
  CAST((s_suppkey * 73) % 361 - 180 AS DOUBLE) AS lon, [50.0, 300.0, 1200.0, 4000.0][s_suppkey % 4 + 1]::DOUBLE AS radius_km FROM supplier),
places AS (SELECT c_custkey AS place_id, CASE WHEN c_custkey % 17 <> 0 THEN ((c_custkey * 7919) % 18001)::DOUBLE / 100.0::DOUBLE - 90.0::DOUBLE END AS plat,
  ((c_custkey * 104729) % 36001)::DOUBLE / 100.0::DOUBLE - 180.0::DOUBLE AS plon FROM customer)
"""
AWAY = geo.haversine_sql("lat", "lon", "plat", "plon")


@query("geo_radius_join", f"""WITH {POINTS} SELECT request_id, place_id, round({AWAY}, 3) AS distance_m
  FROM asked CROSS JOIN places WHERE {AWAY} <= radius_km * 1000""")
def _(spark, sf):
    near = geo.geo_radius_join(supplier_points(spark, sf), customer_points(spark, sf))
    return near.select("request_id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query("geo_distance", f"""WITH {POINTS} SELECT c_custkey, round({AWAY}, 3) AS distance_m FROM customer
  JOIN asked ON request_id = c_nationkey JOIN places ON place_id = c_custkey""")
def _(spark, sf):
    links = t.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("request_id"))
    rows = links.join(supplier_points(spark, sf), "request_id").join(
        customer_points(spark, sf), F.col("place_id") == F.col("c_custkey"))
    away = metres_between(F.col("latitude"), F.col("longitude"), F.col("place_latitude"), F.col("place_longitude"))
    return rows.select("c_custkey", F.round(away, 3).alias("distance_m"))


def candidate_lists(spark, sf):
    """Two candidate lists per user from two kinds of events."""
    def of(kind, score):
        return t.event_pairs(spark, sf, kind, "event_id % 40").withColumn("x", F.col("event_id") % 7).groupBy(
            F.col("user_id").alias("query_id"), F.col("job_id").alias("item_id")
        ).agg(F.max("x").cast("double").alias(score))

    return of("click", "bm25_score"), of("view", "embedding_score")


CANDIDATES = """
b AS (SELECT user_id AS query_id, event_id % 40 AS item_id, max(event_id % 7)::DOUBLE AS bm25_score FROM events WHERE event_type = 'click' GROUP BY 1, 2),
e AS (SELECT user_id AS query_id, event_id % 40 AS item_id, max(event_id % 7)::DOUBLE AS embedding_score FROM events WHERE event_type = 'view' GROUP BY 1, 2),
merged AS (SELECT coalesce(b.query_id, e.query_id) AS query_id, coalesce(b.item_id, e.item_id) AS item_id,
  coalesce(bm25_score, 0) AS bm25_score, coalesce(embedding_score, 0) AS embedding_score
  FROM b FULL JOIN e ON b.query_id = e.query_id AND b.item_id = e.item_id)
"""


@query("merge_candidates", f"WITH {CANDIDATES} SELECT * FROM merged")
def _(spark, sf):
    return joins.merge_candidates(*candidate_lists(spark, sf))


@query("skill_pair_join", f"""WITH {GRAPH},
  sims AS (SELECT src AS skill1, dst AS skill2, max(weight) AS similarity FROM edges GROUP BY 1, 2),
  held AS (SELECT DISTINCT l_orderkey AS id, 'p' || l_partkey AS skill FROM lineitem),
  asked AS (SELECT o_orderkey AS left_id, o_orderkey + 1 AS right_id FROM orders)
  SELECT left_id, right_id, skill1, skill2, similarity FROM asked JOIN held a ON a.id = left_id JOIN held b ON b.id = right_id
  JOIN sims ON skill1 = a.skill AND skill2 = b.skill
  WHERE NOT EXISTS (SELECT 1 FROM held x WHERE x.id = right_id AND x.skill = a.skill)
  AND NOT EXISTS (SELECT 1 FROM held x WHERE x.id = left_id AND x.skill = b.skill)""")
def _(spark, sf):
    """Related parts of each order and its successor."""
    held = t.table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(F.lit("p"), F.col("l_partkey")).alias("skill")).distinct()
    asked = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 1).alias("right_id"))
    _, relations = part_graph(spark, sf)
    sims = graph_ops.skill_edges(relations).groupBy(
        F.col("src").alias("skill1"), F.col("dst").alias("skill2")).agg(F.max("weight").alias("similarity"))
    return joins.skill_pair_join(
        held.withColumnRenamed("l_orderkey", "left_id"), held.withColumnRenamed("l_orderkey", "right_id"), asked, sims)


def asked_ids(spark, sf):
    return t.table(spark, sf, "customer").select(
        asked_uuid().alias("asked_id"), F.col("c_custkey").alias("position"))


def stored_ids(spark, sf):
    return t.table(spark, sf, "customer").where("c_acctbal > 3000").select(
        uuid().alias("job_id"), F.col("c_name").alias("title"))


@query("validate_job_ids", f"""WITH asked AS (SELECT {ASKED_SQL} AS asked_id, c_custkey AS position FROM customer),
  stored AS (SELECT {UUID_SQL} AS job_id FROM customer WHERE c_acctbal > 3000)
  SELECT asked_id, position, NOT regexp_full_match(lower(asked_id), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AS malformed
  FROM asked WHERE asked_id NOT IN (SELECT job_id FROM stored)""")
def _(spark, sf):
    return joins.validate_job_ids(asked_ids(spark, sf), stored_ids(spark, sf))


@query("jobs_by_ids", f"""WITH asked AS (SELECT {ASKED_SQL} AS asked_id FROM customer)
  SELECT {UUID_SQL} AS job_id, c_name AS title FROM customer WHERE c_acctbal > 3000 AND {UUID_SQL} IN (SELECT lower(asked_id) FROM asked)""")
def _(spark, sf):
    return joins.jobs_by_ids(stored_ids(spark, sf), asked_ids(spark, sf))


LOGOS = """
companies AS (SELECT c_custkey AS company_id, c_name AS company_name,
  CASE WHEN c_acctbal > 5000 THEN 'http://logo/' || c_mktsegment || '.png' END AS logo FROM customer),
map AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS input_company,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS identifier FROM customer)
"""


@query("company_logo_update", f"""WITH {LOGOS}, s AS (SELECT m.*, CASE WHEN identifier = '' THEN 'skipped' WHEN company_name IS NULL THEN 'missing'
  WHEN logo = 'http://logo/' || identifier || '.png' THEN 'unchanged' ELSE 'updated' END AS status, false AS ignore_case
  FROM map m LEFT JOIN companies ON input_company = company_name
  UNION ALL SELECT m.*, CASE WHEN identifier = '' THEN 'skipped' WHEN company_name IS NULL THEN 'missing'
  WHEN logo = 'http://logo/' || identifier || '.png' THEN 'unchanged' ELSE 'updated' END, true
  FROM map m LEFT JOIN companies ON lower(input_company) = lower(company_name))
  SELECT ignore_case, status, count(*) AS companies FROM s GROUP BY 1, 2""")
def _(spark, sf):
    rows = logo_map(spark, sf).select(F.trim("input_company").alias("input_company"), "identifier",
                                      F.monotonically_increasing_id().alias("position"))
    parts = []
    for ignore_case in (False, True):
        status, _ = joins.company_logo_update(t.companies(spark, sf), rows, "http://logo", ignore_case)
        parts.append(status.groupBy("status").agg(F.count(F.lit(1)).alias("companies")).withColumn(
            "ignore_case", F.lit(ignore_case)))
    return parts[0].unionByName(parts[1])


@query("company_logo_table", f"""WITH {LOGOS} SELECT company_id, CASE WHEN identifier <> '' AND input_company = company_name
  THEN 'http://logo/' || identifier || '.png' ELSE logo END AS logo FROM companies JOIN map ON company_id = position""")
def _(spark, sf):
    rows = logo_map(spark, sf).select(F.trim("input_company").alias("input_company"), "identifier",
                                      F.monotonically_increasing_id().alias("position"))
    _, updated = joins.company_logo_update(t.companies(spark, sf), rows, "http://logo")
    return updated.select("company_id", "logo")


@query("rejection_status", f"""WITH {PAIRS} SELECT DISTINCT user_id, job_id, EXISTS (SELECT 1 FROM events e
  WHERE event_type = 'signup' AND e.user_id = p.user_id AND e.event_id % (SELECT count(*) FROM embeddings) = p.job_id) AS is_rejected FROM pairs p""")
def _(spark, sf):
    return joins.rejection_status(order_pairs(spark, sf).distinct(), t.event_pairs(spark, sf, "signup"))


@query("audit_foreign_keys", f"""WITH {t.STAR}
  SELECT 'job company' AS "check", 'orphan' AS kind, count(*) AS violations FROM jobs WHERE company_id IS NOT NULL AND company_id NOT IN (SELECT company_id FROM companies)
  UNION ALL SELECT 'job location', 'orphan', count(*) FROM jobs WHERE location_id NOT IN (SELECT location_id FROM locations)
  UNION ALL SELECT 'unique line', 'duplicate', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'unique city', 'duplicate', count(*) FROM (SELECT 1 FROM locations GROUP BY city, country_id HAVING count(*) > 1)""")
def _(spark, sf):
    jobs, places = t.jobs(spark, sf), t.locations(spark, sf)
    return joins.audit_foreign_keys([
        ("job company", jobs, ["company_id"], t.companies(spark, sf), ["company_id"]),
        ("job location", jobs, ["location_id"], places, ["location_id"]),
        ("unique line", t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], None, []),
        ("unique city", places, ["city", "country_id"], None, []),
    ])


# --- set operations -----------------------------------------------------------------------
@query("union_dedup_by_id", """SELECT DISTINCT user_id, job_id, 0 AS tier FROM (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS job_id FROM events WHERE event_type = 'click')
  UNION ALL SELECT DISTINCT user_id, job_id, 1 FROM (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS job_id FROM events WHERE event_type = 'view')
  WHERE (user_id, job_id) NOT IN (SELECT user_id, event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'click')""")
def _(spark, sf):
    first, second = (t.event_pairs(spark, sf, k).select("user_id", "job_id").distinct() for k in ("click", "view"))
    return joins.union_dedup_by_id(first, second, ["user_id", "job_id"])


@query("exclusion_union", """SELECT o_custkey AS user_id, o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT user_id, event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'signup'
  UNION SELECT NULL, event_id % (SELECT count(*) FROM embeddings) FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    return joins.exclusion_union(
        t.applied(spark, sf), t.event_pairs(spark, sf, "signup"), t.event_pairs(spark, sf, "error"))


@query("missing_ids", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    asked = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    found = t.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return joins.missing_ids(asked, found, "id")


@query("skill_set_operations", """WITH a AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_linenumber))) AS s FROM lineitem GROUP BY 1),
  p AS (SELECT x.id, x.s AS f, y.s AS g FROM a x JOIN a y ON y.id = x.id + 1)
  SELECT id, CAST(len(list_intersect(f, g)) AS BIGINT) AS both, CAST(len(list_distinct(list_concat(f, g))) AS BIGINT) AS whole,
  CAST(len(f) - len(list_intersect(f, g)) AS BIGINT) AS only_first FROM p""")
def _(spark, sf):
    """Line-number sets of neighbouring orders; a set holds at most seven numbers."""
    sets = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set("l_linenumber").alias("f"))
    nxt = sets.select((F.col("id") - 1).alias("id"), F.col("f").alias("g"))
    sized = lambda c: F.size(c).cast("bigint")
    return sets.join(nxt, "id").select(
        "id", sized(F.array_intersect("f", "g")).alias("both"), sized(F.array_union("f", "g")).alias("whole"),
        sized(F.array_except("f", "g")).alias("only_first"))


# --- maintenance --------------------------------------------------------------------------
@query("apply_rejections", """WITH log AS (SELECT user_id, event_id % 20 AS job_id, event_id AS seq, ts,
  CASE WHEN event_type = 'error' THEN 'undo' ELSE 'pass' END AS action FROM events),
  u AS (SELECT user_id, job_id, max(seq) AS undo FROM log WHERE action = 'undo' GROUP BY 1, 2)
  SELECT l.user_id, l.job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since FROM log l LEFT JOIN u
  ON l.user_id = u.user_id AND l.job_id = u.job_id WHERE action = 'pass' AND (undo IS NULL OR seq > undo) GROUP BY 1, 2""")
def _(spark, sf):
    log = t.table(spark, sf, "events").select(
        "user_id", (F.col("event_id") % 20).alias("job_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "undo").otherwise("pass").alias("action"))
    state = maintenance.apply_rejections(log)
    return state.select("user_id", "job_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("upsert_preferences", "SELECT user_id, max_by(event_type, event_id) AS experience FROM events GROUP BY user_id")
def _(spark, sf):
    log = t.table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("experience"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))
    return maintenance.upsert_preferences(log)


@query("dedupe_jobs_load", """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n
  FROM orders) WHERE n = 1 OR o_orderpriority = '5-LOW'""")
def _(spark, sf):
    rows = t.table(spark, sf, "orders").withColumn(
        "link", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return maintenance.dedupe_jobs_load(rows, ["o_custkey", "link"], "o_orderkey").select("o_orderkey")


@query("cascade_delete", """SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(spark, sf):
    deleted = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"))
    left = maintenance.cascade_delete(t.field_jobs(spark, sf), deleted)
    return left.groupBy(F.col("job_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
