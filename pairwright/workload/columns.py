"""Column builders over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions import scores, text, vectors
from pairwright.operators.ranking import distinct_requests
from pairwright.workload import tables as t
from pairwright.workload.registry import query


def distance():
    return F.col("value") / 200 - 0.05


DISTANCE_SQL = "(value / 200 - 0.05)"
SIGMOID_SQL = (
    "CASE WHEN {d} IS NULL THEN NULL WHEN {d} < 0 THEN 100.0 WHEN {d} > 2.0 THEN 0.0 "
    "ELSE round(100.0 / (1.0 + exp(13.0 * ({d} - 0.369))), 2) END"
)
LINEAR_SQL = "CASE WHEN {d} <= 2.0 THEN greatest(0.0, 100.0 - {d} * 50.0) ELSE 0.0 END"


def over(table, key, **columns):
    """Run named column expressions over a table."""
    def run(spark, sf):
        return t.table(spark, sf, table).select(key, *[c().alias(n) for n, c in columns.items()])

    return run


query("score_to_percentage", f"SELECT event_id, {SIGMOID_SQL.format(d=DISTANCE_SQL)} AS percentage FROM events")(
    over("events", "event_id", percentage=lambda: scores.score_to_percentage(distance())))

query("score_linear_percentage",
      f"SELECT event_id, round({LINEAR_SQL.format(d=DISTANCE_SQL)}, 6) AS percentage FROM events")(
    over("events", "event_id", percentage=lambda: F.round(scores.score_linear_percentage(distance()), 6)))

query("match_category", """SELECT event_id, CASE WHEN value >= 80 THEN 'excellent' WHEN value >= 60 THEN 'good'
  ELSE 'insufficient' END AS category FROM events""")(
    over("events", "event_id", category=lambda: scores.match_category(F.col("value"))))

query("score_to_strength", """SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'strong' WHEN value / 100 >= 0.5 THEN 'moderate'
  WHEN value / 100 >= 0.2 THEN 'weak' ELSE 'missing' END AS strength FROM events""")(
    over("events", "event_id", strength=lambda: scores.score_to_strength(F.col("value") / 100)))

query("duration_category", """SELECT o_orderkey, CASE WHEN o_totalprice / 5 < 100 THEN 'fast' WHEN o_totalprice / 5 < 500 THEN 'medium'
  WHEN o_totalprice / 5 < 1000 THEN 'slow' WHEN o_totalprice / 5 < 5000 THEN 'very_slow'
  WHEN o_totalprice / 5 < 60000 THEN 'extremely_slow' ELSE 'critical' END AS category FROM orders""")(
    over("orders", "o_orderkey", category=lambda: scores.duration_category(F.col("o_totalprice") / 5)))

query("query_duration_category", """SELECT o_orderkey, CASE WHEN o_totalprice / 30 < 50 THEN 'fast' WHEN o_totalprice / 30 < 200 THEN 'medium'
  WHEN o_totalprice / 30 < 500 THEN 'slow' WHEN o_totalprice / 30 < 2000 THEN 'very_slow'
  WHEN o_totalprice / 30 < 10000 THEN 'extremely_slow' ELSE 'critical' END AS category FROM orders""")(
    over("orders", "o_orderkey", category=lambda: scores.query_duration_category(F.col("o_totalprice") / 30)))


def listed():
    return F.when(F.col("p_size") % 9 == 0, F.lit(None)).otherwise(F.concat(
        F.when(F.col("p_size") % 2 == 0, F.lit("{")).otherwise(F.lit("")),
        F.lit('"'), F.col("p_name"), F.lit('", '), F.col("p_type"), F.lit(",, '"), F.col("p_brand"), F.lit("'"),
        F.when(F.col("p_size") % 2 == 0, F.lit("}")).otherwise(F.lit("")),
    ))


LISTED_SQL = """CASE WHEN p_size % 9 = 0 THEN NULL ELSE '"' || p_name || '", ' || p_type || ',, ''' || p_brand || '''' END"""

query("parse_skills", f"""SELECT p_partkey, coalesce(array_to_string(list_transform(list_filter(list_transform(
  string_split({LISTED_SQL}, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: trim(trim(x, '"'), '''')), ';'), '') AS skills FROM part""")(
    over("part", "p_partkey", skills=lambda: F.array_join(text.parse_skills(listed()), ";")))

query("parse_skills_schema", f"""SELECT p_partkey, coalesce(array_to_string(list_transform(
  string_split({LISTED_SQL}, ','), lambda x: trim(trim(x), '"')), ';'), '') AS skills FROM part""")(
    over("part", "p_partkey", skills=lambda: F.array_join(text.parse_skills_schema(listed()), ";")))


@query("normalize_embedding", """SELECT vec_id, 80::BIGINT AS padded_size, 40::BIGINT AS cut_size,
  round(list_sum(embedding::DOUBLE[]), 6) AS padded_sum, round(list_sum(embedding[1:40]::DOUBLE[]), 6) AS cut_sum FROM embeddings""")
def _(spark, sf):
    """Padded from arrays, truncated from their text form."""
    rows = t.table(spark, sf, "embeddings")
    as_text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]"))
    padded = vectors.normalize_embedding(F.col("embedding"), 80)
    cut = vectors.normalize_embedding(as_text, 40, text=True)
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select(
        "vec_id", F.size(padded).cast("bigint").alias("padded_size"), F.size(cut).cast("bigint").alias("cut_size"),
        total(padded).alias("padded_sum"), total(cut).alias("cut_sum"),
    )


@query("location_label", f"WITH {t.STAR} SELECT job_id, city || ', ' || country AS label FROM flat")
def _(spark, sf):
    return t.flat_jobs(spark, sf).select("job_id", text.location_label(F.col("city"), F.col("country")).alias("label"))



def uuid():
    digest = F.md5(F.col("c_name"))
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in spans])


def asked_uuid():
    key = F.col("c_custkey")
    return F.when(key % 5 == 0, F.upper(uuid())).when(key % 7 == 0, F.concat(uuid(), F.lit("x"))).otherwise(uuid())


UUID_SQL = ("(substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) "
            "|| '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12))")
ASKED_SQL = f"CASE WHEN c_custkey % 5 = 0 THEN upper({UUID_SQL}) WHEN c_custkey % 7 = 0 THEN {UUID_SQL} || 'x' ELSE {UUID_SQL} END"

query("uuid_valid", "SELECT c_custkey, (c_custkey % 5 = 0 OR c_custkey % 7 <> 0) AS valid FROM customer")(
    over("customer", "c_custkey", valid=lambda: text.uuid_valid(asked_uuid())))

query("keywords_to_phrase", "SELECT p_partkey, p_name || ' ' || p_type AS phrase FROM part")(
    over("part", "p_partkey", phrase=lambda: text.keywords_to_phrase(F.array("p_name", "p_type"))))


@query("clean_location_filters", """SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_mktsegment END AS country,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_name END AS city,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_acctbal END AS latitude, 5.0::DOUBLE AS radius_km FROM customer""")
def _(spark, sf):
    rows = t.table(spark, sf, "customer").withColumn("locations", F.array(F.struct(
        F.when(F.col("c_acctbal") < 2000, "  ").otherwise(F.col("c_mktsegment")).alias("country"),
        F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("city"),
        F.col("c_acctbal").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(5.0).alias("radius_km"),
    )))
    return rows.select("c_custkey", F.explode(text.clean_location_filters(F.col("locations"))).alias("l")).select(
        "c_custkey", "l.country", "l.city", "l.latitude", "l.radius_km")


@query("match_request_key", """SELECT k AS request_key, count(*) AS requests, min(c_custkey) AS request_id FROM (SELECT c_custkey,
  c_mktsegment || '_experience_[''' || array_to_string(list_sort(['Entry-level', c_mktsegment]), ''', ''') || ''']_offset_' || (c_nationkey % 2)
  || '_applied_ids_hash_' || sha256((c_nationkey % 2) || ',1') AS k FROM customer) GROUP BY k""")
def _(spark, sf):
    half = F.col("c_nationkey") % 2
    keyed = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        text.match_request_key(
            [F.col("c_mktsegment")],
            {"offset": half, "keywords": F.lit(None).cast("string"),
             "experience": text.sorted_list_text(F.array(F.col("c_mktsegment"), F.lit("Entry-level")))},
            applied_ids=F.array(F.lit(1), half),
        ).alias("request_key"),
    )
    # '0' sorts before '1', so the hashed list is ordered by text
    return distinct_requests(keyed)


query("extract_host", r"""SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^([^/?#]*)', 1), '^www\.', '') AS host,
  regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^([^/?#]*)', 1) AS bare_host FROM pages""")(
    over("pages", "page_id", host=lambda: text.extract_host(F.col("url"), strip_www=True),
         bare_host=lambda: text.extract_host(F.regexp_replace("url", "^[a-z]+://", ""))))

query("safe_name", """SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages""")(
    over("pages", "page_id", name=lambda: text.safe_name(F.col("url"))))


@query("tokenize_bm25", f"""SELECT doc_id, CAST(len(tok) AS BIGINT) AS n, md5(array_to_string(tok, ' ')) AS tokens
  FROM (SELECT doc_id, {t.tokens_sql()} AS tok FROM documents)""")
def _(spark, sf):
    tokens = t.documents(spark, sf).select("doc_id", text.tokenize_bm25(F.col("text")).alias("tok"))
    return tokens.select("doc_id", F.size("tok").cast("bigint").alias("n"), F.md5(F.array_join("tok", " ")).alias("tokens"))
