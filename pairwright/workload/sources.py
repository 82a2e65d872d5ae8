"""Scans and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators.joins import is_job_applied as flag_applied
from pairwright.session import scratch_path
from pairwright.sources import readers, writers
from pairwright.workload import tables as t
from pairwright.workload.registry import query


@query("scan_jobs_star", f"""WITH {t.STAR} SELECT job_id, title, description, experience,
  strftime(posted_date, '%Y-%m-%d') AS posted, country, city, company_name, logo AS company_logo FROM flat""")
def _(spark, sf):
    star = readers.scan_jobs_star(
        t.jobs(spark, sf), t.companies(spark, sf), t.locations(spark, sf), t.countries(spark, sf)
    )
    return star.withColumn("posted", t.day("posted_date")).drop("posted_date")


def job_texts(spark, sf):
    """Documents as job rows with a title, two descriptions, a state and maybe a vector."""
    docs, vectors = t.table(spark, sf, "documents"), t.table(spark, sf, "embeddings")
    return docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit(" "), F.col("source")).alias("title"),
        F.when(F.col("n_chars") % 7 == 0, "").otherwise(F.col("text")).alias("description"),
        F.col("lang").alias("short_description"),
        F.when(F.col("n_chars") > 300, "Active").otherwise("Closed").alias("job_state"), "embedding",
    )


@query("scan_active_jobs_text", r"""WITH j AS (SELECT doc_id AS job_id, regexp_replace(' ' || source || ' ' ||
  CASE WHEN n_chars % 7 = 0 THEN lang ELSE text END, '^\s+|\s+$', '', 'g') AS text
  FROM documents JOIN embeddings ON doc_id = vec_id WHERE n_chars > 300)
  SELECT job_id, md5(text) AS text_hash, CAST(length(text) AS BIGINT) AS n FROM j WHERE text <> ''""")
def _(spark, sf):
    texts = readers.scan_active_jobs_text(job_texts(spark, sf))
    return texts.select("job_id", F.md5("text").alias("text_hash"), F.length("text").cast("bigint").alias("n"))


@query("scan_resumes", """SELECT user_id, min(doc_id) AS resume_id FROM (SELECT doc_id, doc_id % 997 AS user_id, text
  FROM documents JOIN embeddings ON doc_id = vec_id) WHERE text <> '' GROUP BY user_id""")
def _(spark, sf):
    docs, vectors = t.table(spark, sf, "documents"), t.table(spark, sf, "embeddings")
    resumes = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("resume_id"), (F.col("doc_id") % 997).alias("user_id"), "text",
        F.col("embedding").alias("vector"),
    )
    return readers.scan_resumes(resumes).select("user_id", "resume_id")


@query("scan_applied_jobs", """SELECT o_custkey AS user_id, unnest([o_orderkey, o_orderkey + 1]) AS job_id FROM orders""")
def _(spark, sf):
    listed = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("job_ids")
    )
    return readers.scan_applied_jobs(listed)


@query("is_job_applied", """SELECT o_custkey AS user_id, o_orderkey AS job_id, o_orderstatus = 'F' AS is_applied FROM orders""")
def _(spark, sf):
    pairs = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id")
    )
    return flag_applied(pairs, t.applied(spark, sf))


@query("scan_cooled_jobs", "SELECT event_id AS job_id FROM events WHERE value >= 5")
def _(spark, sf):
    cooled = t.table(spark, sf, "events").select(
        F.expr("CASE WHEN value < 5 THEN NULL ELSE event_id END").alias("job_id")
    )
    return readers.scan_cooled_jobs(cooled)


@query("scan_rejected_jobs", "SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS job_id FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    return readers.scan_rejected_jobs(t.event_pairs(spark, sf, "signup"))


def samples(spark, sf):
    """Conversations' turns as training samples: an answer is the positive of its question."""
    turns = t.table(spark, sf, "conversations")
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("sample_id"),
        F.col("conv_id").cast("string").alias("resume_id"), F.col("text").alias("resume_text"),
        F.array(F.lit(0.5)).alias("resume_embedding"),
        (F.col("turn") + 1).cast("string").alias("positive_job_id"), F.col("answer").alias("positive_job_text"),
        F.when(F.col("turn") % 2 == 0, F.array(F.lit("n1"), F.lit("n2"))).otherwise(F.array(F.lit("n1")))
        .alias("hard_negative_job_ids"),
        F.array(F.col("role")).alias("hard_negative_job_texts"),
        F.when(F.col("turn") % 3 == 0, "feedback").otherwise("application").alias("source"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.when(F.col("turn") % 2 == 0, F.lit("bm25")).alias("mining_strategy"),
    )


SAMPLES = """
samples AS (SELECT a.conv_id || '-' || a.turn AS sample_id, a.text AS resume_text, b.text AS positive_job_text,
  CASE WHEN a.turn % 2 = 0 THEN 2 ELSE 1 END AS negatives,
  CASE WHEN a.turn % 3 = 0 THEN 'feedback' ELSE 'application' END AS source,
  CASE WHEN a.turn % 2 = 0 THEN 'bm25' ELSE 'combined' END AS mining_strategy
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
"""


def _read_samples(spark, sf):
    path = scratch_path(spark, "samples")
    writers.sink_training_jsonl(samples(spark, sf), path)
    return path, readers.scan_training_jsonl(spark, path)


@query("scan_training_jsonl", f"""WITH {SAMPLES} SELECT sample_id, md5(resume_text) AS resume_hash,
  md5(positive_job_text) AS positive_hash, CAST(negatives AS BIGINT) AS negatives, source, mining_strategy FROM samples""")
def _(spark, sf):
    _, rows = _read_samples(spark, sf)
    return rows.select(
        "sample_id", F.md5("resume_text").alias("resume_hash"), F.md5("positive_job_text").alias("positive_hash"),
        F.size("hard_negative_job_ids").cast("bigint").alias("negatives"), "source", "mining_strategy",
    )


@query("sink_training_jsonl", f"""WITH {SAMPLES} SELECT count(*) AS sample_count, 0.1::DOUBLE AS validation_split,
  0.1::DOUBLE AS test_split FROM samples""")
def _(spark, sf):
    path, _ = _read_samples(spark, sf)
    schema = "sample_count bigint, validation_split double, test_split double"
    return spark.read.schema(schema).json(f"{path}/metadata")


def part_graph(spark, sf):
    """Parts as skills; parts on neighbouring lines of an order are related.

    The relation is by return flag, the weight by discount; ``seq`` follows the pair.
    """
    parts = t.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("category"), F.array(F.col("p_type")).alias("aliases"),
        F.col("p_partkey").cast("int").alias("seq"),
    )
    # one deal by order serves the lines and their neighbours
    lines = t.table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag",
    ).repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("a"), F.max("l_discount").alias("d"), F.max("l_returnflag").alias("f")
    )
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    links = lines.withColumns({"next": F.lead("l_linenumber").over(along), "b": F.lead("a").over(along)}).where(
        "next = l_linenumber + 1 AND a <> b").groupBy("a", "b").agg(F.max("d").alias("d"), F.min("f").alias("f"))
    relations = links.select(
        F.concat(F.lit("p"), F.col("a")).alias("source"), F.concat(F.lit("p"), F.col("b")).alias("target"),
        F.expr("CASE f WHEN 'A' THEN 'alternative' WHEN 'N' THEN 'requires' ELSE 'used_with' END").alias("relation"),
        F.round(F.col("d") * 9, 4).alias("weight"), (F.col("a") * 100003 + F.col("b")).cast("bigint").alias("seq"),
    )
    return parts, relations


GRAPH = """
parts AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS category, p_type AS alias, p_partkey AS seq FROM part),
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS a, max(l_discount) AS d, max(l_returnflag) AS f
  FROM lineitem GROUP BY 1, 2),
links AS (SELECT x.a, y.a AS b, max(x.d) AS d, min(x.f) AS f FROM lines x JOIN lines y
  ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.a <> y.a GROUP BY 1, 2),
relations AS (SELECT 'p' || a AS source, 'p' || b AS target,
  CASE f WHEN 'A' THEN 'alternative' WHEN 'N' THEN 'requires' ELSE 'used_with' END AS relation,
  round(d * 9, 4) AS weight, a * 100003 + b AS seq FROM links),
edges AS (SELECT source AS src, target AS dst, relation, weight, seq * 2 AS seq FROM relations
  UNION ALL SELECT target, source, relation, weight, seq * 2 + 1 FROM relations WHERE relation <> 'requires')
"""


def _taxonomy_files(spark, sf):
    skills, relations = part_graph(spark, sf)
    path = scratch_path(spark, "taxonomy")
    writers.sink_taxonomy_json(skills, relations, path)
    return readers.scan_taxonomy_tables(spark, path)


@query("sink_taxonomy_json", f"""WITH {GRAPH} SELECT relation, count(*) AS relations, round(sum(weight), 4) AS weight
  FROM relations GROUP BY relation""")
def _(spark, sf):
    _, relations = _taxonomy_files(spark, sf)
    return relations.groupBy("relation").agg(
        F.count(F.lit(1)).alias("relations"), F.round(F.sum("weight"), 4).alias("weight")
    )


@query("scan_taxonomy_json", "SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS category, p_type AS alias FROM part")
def _(spark, sf):
    """One small taxonomy document per part, one document per line."""
    parts, _relations = part_graph(spark, sf)
    path = scratch_path(spark, "taxonomy-document")
    parts.select(F.array(F.struct(
        "id", "name", F.col("id").alias("canonical_name"), "category", "aliases"
    )).alias("skills")).write.json(path)
    skills, _none = readers.scan_taxonomy_json(spark, path, multi_line=False)
    return skills.select("id", "name", "category", F.col("aliases")[0].alias("alias"))


@query("scan_raw_scores_csv", "SELECT round(value / 200, 6) AS raw_score FROM events")
def _(spark, sf):
    path = scratch_path(spark, "scores")
    t.table(spark, sf, "events").select((F.col("value") / 200).alias("raw_score")).write.option(
        "header", True).csv(path)
    return readers.scan_raw_scores_csv(spark, path).select(F.round("raw_score", 6).alias("raw_score"))


@query("scan_statsd_log", """SELECT s.section, e.event_type || s.suffix AS name, count(*) AS samples,
  round(sum(CASE s.section WHEN 'histogram' THEN value ELSE value END), 4) AS total
  FROM events e CROSS JOIN (VALUES ('counter', '.requests.total'), ('gauge', '.response.size'),
  ('histogram', '.request.duration')) AS s(section, suffix) GROUP BY 1, 2""")
def _(spark, sf):
    """One flush text per event, with a counter, a gauge and a histogram section."""
    shown = F.format_string("%.2f", F.col("value"))
    flush = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ---\n\nCounters:\n  "), F.col("event_type"),
        F.lit(".requests.total = "), shown, F.lit(" {}\n\nGauges:\n  "), F.col("event_type"),
        F.lit(".response.size = "), shown, F.lit(" {}\n\nHistograms:\n  "), F.col("event_type"),
        F.lit(".request.duration (count=1, min="), shown, F.lit(", avg="), shown, F.lit(", max="), shown,
        F.lit(") {}\n\n--- End metrics (0 received) ---\n"),
    )
    path = scratch_path(spark, "dump")
    t.table(spark, sf, "events").select(F.concat(F.lit("\n--- Metrics flush at "), flush)).write.text(path)
    rows = readers.scan_statsd_log(spark, path)
    return rows.groupBy("section", "name").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum(F.coalesce("value", "avg")), 4).alias("total")
    )


def logo_map(spark, sf):
    return t.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
        .alias("input_company"),
        F.lit("m").alias("matched_name"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("identifier"),
        F.lit("").alias("logo_url"), F.lit("").alias("error"),
    )


@query("scan_company_logo_map", """SELECT CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS input_company,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS identifier FROM customer""")
def _(spark, sf):
    path = scratch_path(spark, "logos")
    logo_map(spark, sf).write.option("header", True).csv(path)
    return readers.scan_company_logo_map(spark, path).select("input_company", "identifier")


@query("sink_matches", "SELECT user_id AS resume_id, event_id % (SELECT count(*) FROM embeddings) AS job_id, '2003-01-01' AS run_date FROM events")
def _(spark, sf):
    path = scratch_path(spark, "matches")
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").alias("resume_id"), (F.col("event_id") % t.n_vectors(spark, sf)).alias("job_id")
    )
    writers.sink_matches(rows, path, t.as_of())
    stored = spark.read.parquet(path)
    return stored.select("resume_id", "job_id", F.col("run_date").cast("string").alias("run_date"))


@query("sink_search_requests", """SELECT event_id AS user_id, strftime(ts, '%Y-%m-%d') AS asked,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(user_id + value, 4) END AS place,
  event_type || '|' || 'big' || '|' || 'job' AS keywords FROM events""")
def _(spark, sf):
    events = t.table(spark, sf, "events")
    asked = events.select(
        F.col("event_id").alias("user_id"), F.col("ts").alias("time"),
        F.array(F.struct(
            F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("double").alias("latitude"),
            F.col("value").alias("longitude"),
        )).alias("locations"),
        F.array(F.upper("event_type"), F.lit("Big Job")).alias("keywords"),
    )
    path = scratch_path(spark, "requests")
    writers.sink_search_requests(asked, path)
    stored = spark.read.parquet(path)
    return stored.select(
        "user_id", t.day("time").alias("asked"),
        F.round(F.col("location")[0] + F.col("location")[1], 4).alias("place"),
        F.array_join("keywords", "|").alias("keywords"),
    )
