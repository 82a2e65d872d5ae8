"""The engine's tables derived from the test tables, in Spark and as SQL.

jobs = orders, companies = customer, locations = nation, countries = region, fields = part,
field links = lineitem, searchable vectors = embeddings, requests = supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2003-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def day(column) -> F.col:
    return F.date_format(column, "yyyy-MM-dd")


# --- star schema ---------------------------------------------------------------------
def jobs(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("role "), F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("status "), F.col("o_orderstatus")).alias("description"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior-level' WHEN '2-HIGH' THEN 'Mid-level' "
               "WHEN '3-MEDIUM' THEN 'Entry-level' WHEN '5-LOW' THEN 'Internship' END").alias("experience"),
        F.col("o_orderdate").alias("posted_date"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END").alias("company_id"),
        (F.col("o_custkey") % 27).cast("int").alias("location_id"),
    )


def companies(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"),
        F.expr("CASE WHEN c_acctbal > 5000 THEN concat('http://logo/', c_mktsegment, '.png') END").alias("logo"),
    )


def locations(spark, folder) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        key.alias("location_id"),
        F.when(key % 10 == 0, F.lit("remote")).otherwise(F.col("n_name")).alias("city"),
        ((key * 37) % 140 - 70).cast("double").alias("latitude"),
        ((key * 73) % 360 - 180).cast("double").alias("longitude"),
        F.col("n_regionkey").alias("country_id"),
    )


def countries(spark, folder) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("country_id"),
        F.when(F.col("r_name") == "AMERICA", "United States").otherwise(F.col("r_name")).alias("country_name"),
    )


def flat_jobs(spark, folder) -> DataFrame:
    from pairwright.operators.joins import join_star_left

    return join_star_left(
        jobs(spark, folder), companies(spark, folder), locations(spark, folder), countries(spark, folder)
    ).withColumnRenamed("country_name", "country")


STAR = """
jobs AS (SELECT o_orderkey AS job_id, 'role ' || o_orderpriority AS title,
  'status ' || o_orderstatus AS description,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior-level' WHEN '2-HIGH' THEN 'Mid-level'
    WHEN '3-MEDIUM' THEN 'Entry-level' WHEN '5-LOW' THEN 'Internship' END AS experience,
  o_orderdate AS posted_date,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS company_id,
  CAST(o_custkey % 27 AS INT) AS location_id FROM orders),
companies AS (SELECT c_custkey AS company_id, c_name AS company_name,
  CASE WHEN c_acctbal > 5000 THEN 'http://logo/' || c_mktsegment || '.png' END AS logo FROM customer),
locations AS (SELECT n_nationkey AS location_id,
  CASE WHEN n_nationkey % 10 = 0 THEN 'remote' ELSE n_name END AS city,
  CAST((n_nationkey * 37) % 140 - 70 AS DOUBLE) AS latitude,
  CAST((n_nationkey * 73) % 360 - 180 AS DOUBLE) AS longitude, n_regionkey AS country_id FROM nation),
countries AS (SELECT r_regionkey AS country_id,
  CASE WHEN r_name = 'AMERICA' THEN 'United States' ELSE r_name END AS country_name FROM region),
flat AS (SELECT j.*, c.company_name, c.logo, l.city, l.latitude, l.longitude, co.country_name AS country
  FROM jobs j LEFT JOIN companies c ON j.company_id = c.company_id
  LEFT JOIN locations l ON j.location_id = l.location_id
  LEFT JOIN countries co ON l.country_id = co.country_id)
"""


# --- fields ----------------------------------------------------------------------------
def fields(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("field_id"), F.col("p_brand").alias("root_field"),
        F.col("p_type").alias("sub_field"),
    )


def field_jobs(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("field_id")
    )


# --- interactions ------------------------------------------------------------------------
def applied(spark, folder) -> DataFrame:
    """Finished orders, as applications of the customer."""
    return table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id")
    )


def n_vectors(spark, folder) -> int:
    return table(spark, folder, "embeddings").count()


def event_pairs(spark, folder, kind: str, jobs: str | None = None) -> DataFrame:
    """(user_id, job_id) of one kind of event; the event ids are spread over all vectors' ids."""
    job = F.expr(jobs) if jobs else F.col("event_id") % n_vectors(spark, folder)
    return table(spark, folder, "events").where(F.col("event_type") == kind).select(
        "user_id", job.alias("job_id"), "ts", "event_id"
    )


# --- requests ------------------------------------------------------------------------------
_LOC = "struct<country:string,city:string,latitude:double,longitude:double,radius_km:double>"


def requests(spark, folder) -> DataFrame:
    """One request per supplier; ``kind`` decides which filters it carries."""
    supplier = table(spark, folder, "supplier")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key, kind = F.col("n_nationkey"), F.col("s_suppkey") % 5
    country = F.when(F.col("r_name") == "AMERICA", "USA").otherwise(F.col("r_name"))
    lat = ((key * 37) % 140 - 70 + 1).cast("double")
    lon = ((key * 73) % 360 - 180 + 1).cast("double")
    nothing = F.lit(None)

    def loc(country_=nothing, city_=nothing, lat_=nothing, lon_=nothing, radius_=nothing):
        return F.struct(
            country_.cast("string").alias("country"), city_.cast("string").alias("city"),
            lat_.cast("double").alias("latitude"), lon_.cast("double").alias("longitude"),
            radius_.cast("double").alias("radius_km"),
        )

    locations_ = (
        F.when(kind == 1, F.array(loc(country)))
        .when(kind == 2, F.array(loc(country, F.col("n_name"))))
        .when(kind == 3, F.array(loc(nothing, F.col("n_name"), lat, lon, F.lit(2500.0))))
        .when(kind == 4, F.array(loc(nothing, F.col("n_name")), loc(country, nothing, lat, lon, F.lit(400.0))))
        .otherwise(F.array().cast(f"array<{_LOC}>"))
    )
    return rows.select(
        F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("user_id"), locations_.alias("locations"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(" URGENT"), F.lit("x"))).alias("keywords"),
        F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("Senior-level"), F.lit("Boss"), F.lit("Mid-level")))
        .when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("Boss"))).alias("experience"),
        F.when(F.col("s_suppkey") % 11 == 0, F.lit("CUSTOMER#000000007")).alias("company"),
        (F.col("s_suppkey") % 7 == 0).alias("is_remote_only"),
        F.when(F.col("s_suppkey") % 6 == 0, F.array(
            (F.col("s_suppkey") % 200).cast("int"), ((F.col("s_suppkey") * 7) % 200).cast("int")
        )).alias("fields"),
    )


REQUESTS = """
requests AS (SELECT s_suppkey AS request_id, s_suppkey % 5 AS kind, n_name, n_nationkey,
  CASE WHEN r_name = 'AMERICA' THEN 'United States' ELSE r_name END AS want_country,
  CAST((n_nationkey * 37) % 140 - 70 + 1 AS DOUBLE) AS lat,
  CAST((n_nationkey * 73) % 360 - 180 + 1 AS DOUBLE) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
_HAVERSINE = (
    "2*6371008.8*asin(sqrt(least(1.0, power(sin((radians(f.latitude)-radians(r.lat))/2),2)"
    "+cos(radians(r.lat))*cos(radians(f.latitude))*power(sin((radians(f.longitude)-radians(r.lon))/2),2))))"
)
LOCATION_TEST = f"""(CASE r.kind WHEN 0 THEN true
  WHEN 1 THEN f.country = r.want_country
  WHEN 2 THEN f.country = r.want_country AND f.city IN (r.n_name, 'remote')
  WHEN 3 THEN coalesce(f.city = 'remote' OR {_HAVERSINE} <= 2500000, false)
  ELSE coalesce(f.city IN (r.n_name, 'remote'), false)
    OR coalesce(f.country = r.want_country AND (f.city = 'remote' OR {_HAVERSINE} <= 400000), false) END)"""
EXPERIENCE_TEST = (
    "(r.request_id % 4 <> 0 OR coalesce(f.experience IN ('Senior-level', 'Mid-level'), false))"
)
PHRASE_TEST = "(r.request_id % 3 <> 0 OR f.title ILIKE '%URGENT%' OR f.description ILIKE '%URGENT%')"
COMPANY_TEST = "(r.request_id % 11 <> 0 OR coalesce(f.company_name ILIKE 'CUSTOMER#000000007', false))"
REMOTE_TEST = "(r.request_id % 7 <> 0 OR coalesce(lower(f.city) LIKE '%remote%', false))"
FIELDS_TEST = (
    "(r.request_id % 6 <> 0 OR f.job_id IN (SELECT l_orderkey FROM lineitem "
    "WHERE l_partkey IN (r.request_id % 200, (r.request_id * 7) % 200)))"
)

# --- texts -----------------------------------------------------------------------------------
NON_ASCII = r"[^\x00-\x7F]"


def ascii_text(column="text"):
    """Non-ASCII characters become '~', so that word boundaries are the same in every engine."""
    return F.regexp_replace(F.col(column), NON_ASCII, "~")


def documents(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").withColumn("text", ascii_text())


def stop_list() -> str:
    from pairwright.fixed_values import STOPWORDS

    return "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(text: str = "text") -> str:
    return (
        f"list_filter(regexp_extract_all(lower(regexp_replace({text}, '{NON_ASCII}', '~', 'g')), "
        rf"'\b[a-z][a-z0-9+#]*\b'), lambda t: length(t) > 1 AND NOT list_contains({stop_list()}, t))"
    )


# --- vectors -----------------------------------------------------------------------------------
def job_vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("job_id"), F.col("embedding").alias("job_vector"), "label"
    )


def resume_vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("resume_id"), F.col("embedding").alias("resume_vector"), "label"
    )


COSINE = (
    "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
)
