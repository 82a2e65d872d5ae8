"""BM25 over all documents; the benchmark passages are the queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairwright.operators import mining, terms
from pairwright.session import scratch_path
from pairwright.sources.readers import saved_index
from pairwright.sources.writers import save_index
from pairwright.workload import tables as t
from pairwright.workload.registry import query

POSTINGS = f"""
tok AS (SELECT doc_id, {t.tokens_sql()} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean_length FROM tok),
post AS (SELECT doc_id, token, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY 1, 2),
stats AS (SELECT token, count(*) AS df, ln(((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM post GROUP BY 1),
impact AS (SELECT doc_id, token, tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT mean_length FROM corpus))) AS impact FROM post)
"""
SEARCH = POSTINGS + f""",
qtok AS (SELECT item_id AS query_id, unnest({t.tokens_sql()}) AS token FROM benchmark),
qt AS (SELECT query_id, token, count(*) AS qtf FROM qtok GROUP BY 1, 2),
found AS (SELECT query_id, doc_id, round(sum(qtf * idf * impact), 9) AS s FROM qt JOIN stats USING (token) JOIN impact USING (token) GROUP BY 1, 2)
"""


@query("bm25_corpus_stats", f"WITH {POSTINGS} SELECT token, df, round(idf, 9) AS idf FROM stats")
def _(spark, sf):
    return terms.bm25_corpus_stats(t.documents(spark, sf)).withColumn("idf", F.round("idf", 9))


@query("bm25_index_table", f"WITH {POSTINGS} SELECT doc_id, count(*) AS terms, round(sum(impact), 6) AS impact FROM impact GROUP BY 1")
def _(spark, sf):
    """The index as a bucketed table in the shared folder, summed per document."""
    index, _ = saved(spark, t.documents(spark, sf))
    return index.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("impact"), 6).alias("impact"))


#: Rows of the index in a bucket: few enough to be sorted in memory.
BUCKET_ROWS = 4_000_000


def saved(spark, docs, doc_id="doc_id"):
    """(index, stats) of documents, written as tables bucketed by token and read from there."""
    name = f"bm25_{uuid.uuid4().hex}"
    index, stats = terms.build_index(docs, doc_id)
    buckets = max(spark.sparkContext.defaultParallelism, -(-index.count() // BUCKET_ROWS))
    save_index(index, stats, name, scratch_path(spark, "bm25"), buckets)
    return saved_index(spark, name)


def benchmark_queries(spark, sf):
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), t.ascii_text().alias("text"))


def applied_docs(spark, sf):
    """(query, document) pairs to leave out, from events of a kind; the ids are spread over all queries and documents."""
    asked, docs = (t.table(spark, sf, name).count() for name in ("benchmark", "documents"))
    return t.table(spark, sf, "events").where("event_type = 'error'").select(
        (F.col("user_id") % asked).alias("query_id"), (F.col("event_id") % docs).alias("doc_id")).distinct()


#: What ``applied_docs`` gives.
LEFT_OUT = """SELECT user_id % (SELECT count(*) FROM benchmark) AS u, event_id % (SELECT count(*) FROM documents) AS j
  FROM events WHERE event_type = 'error'"""


@query("bm25_search", f"""WITH {SEARCH} SELECT query_id, doc_id, round(s, 6) AS bm25_score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM found WHERE s > 0 AND (query_id, doc_id) NOT IN
  ({LEFT_OUT})) WHERE rank <= 20""")
def _(spark, sf):
    found = terms.bm25_search(
        benchmark_queries(spark, sf), t.documents(spark, sf), 20, excluded=applied_docs(spark, sf))
    return found.withColumn("bm25_score", F.round("bm25_score", 6))


# --- hard negatives: resumes are the benchmark passages, jobs the documents with a vector --------
def resumes(spark, sf):
    """Benchmark passages with the vector of the same number, one user each."""
    vectors = t.table(spark, sf, "embeddings")
    return benchmark_queries(spark, sf).join(vectors, F.col("query_id") == F.col("vec_id"), "left").select(
        F.col("query_id").alias("resume_id"), F.col("query_id").alias("user_id"), "text",
        F.col("embedding").alias("resume_vector"))


def job_documents(spark, sf):
    vectors = t.table(spark, sf, "embeddings")
    return t.documents(spark, sf).join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("job_id"), "text", F.col("embedding").alias("job_vector"))


def applications(spark, sf):
    return applied_docs(spark, sf).select(F.col("query_id").alias("user_id"), F.col("doc_id").alias("job_id"))


def positives(spark, sf):
    return applications(spark, sf).withColumnRenamed("user_id", "resume_id")


BAND = (0.05, 0.9)
OUT = f"({LEFT_OUT})"


def mined_sql(k_bm25, k_emb):
    return SEARCH + f""",
bm AS (SELECT query_id AS resume_id, doc_id AS job_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank
  FROM found WHERE s > 0 AND (query_id, doc_id) NOT IN {OUT}),
cosines AS (SELECT a.item_id AS resume_id, v.vec_id AS job_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS c
  FROM benchmark a JOIN embeddings e ON e.vec_id = a.item_id CROSS JOIN (SELECT vec_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id) v),
em AS (SELECT resume_id, job_id, c, row_number() OVER (PARTITION BY resume_id ORDER BY c DESC, job_id) AS rank FROM cosines
  WHERE c BETWEEN {BAND[0]} AND {BAND[1]} AND (resume_id, job_id) NOT IN {OUT}),
bk AS (SELECT * FROM bm WHERE rank <= {k_bm25}), ek AS (SELECT * FROM em WHERE rank <= {k_emb}),
mg AS (SELECT coalesce(bk.resume_id, ek.resume_id) AS resume_id, coalesce(bk.job_id, ek.job_id) AS job_id, coalesce(bk.s, 0) AS s, coalesce(ek.c, 0) AS c
  FROM bk FULL JOIN ek ON bk.resume_id = ek.resume_id AND bk.job_id = ek.job_id),
sc AS (SELECT *, coalesce(nullif(max(s) OVER (PARTITION BY resume_id), 0), 1) AS ms, coalesce(nullif(max(c) OVER (PARTITION BY resume_id), 0), 1) AS mc FROM mg),
combined AS (SELECT resume_id, job_id, round(CASE WHEN c > 0 THEN 0.4::DOUBLE * (s / ms) + 0.6::DOUBLE * (c / mc) ELSE s / ms END, 9) AS x FROM sc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY x DESC, job_id) AS rank FROM combined) WHERE rank <= 7)
"""


@query("mine_bm25_negatives", f"WITH {mined_sql(21, 21)} SELECT resume_id, job_id, round(s, 6) AS bm25_score, rank FROM bk")
def _(spark, sf):
    jobs = job_documents(spark, sf)
    index, stats = saved(spark, jobs, "job_id")
    mined = mining.mine_bm25_negatives(resumes(spark, sf), jobs, positives(spark, sf), index=index, stats=stats)
    return mined.withColumn("bm25_score", F.round("bm25_score", 6))


@query("mine_embedding_negatives", f"WITH {mined_sql(21, 21)} SELECT resume_id, job_id, round(c, 6) AS embedding_score, rank FROM ek")
def _(spark, sf):
    mined = mining.mine_embedding_negatives(
        resumes(spark, sf), job_documents(spark, sf), positives(spark, sf), band=BAND)
    return mined.withColumn("embedding_score", F.round("embedding_score", 6))


@query("mine_combined_negatives", f"WITH {mined_sql(14, 14)} SELECT resume_id, job_id, round(x, 6) AS combined_score, rank FROM best")
def _(spark, sf):
    mined = mining.mine_combined_negatives(
        resumes(spark, sf), job_documents(spark, sf), positives(spark, sf), band=BAND)
    return mined.select("resume_id", "job_id", F.round("combined_score", 6).alias("combined_score"), "rank")


@query("build_training_dataset", f"""WITH {mined_sql(14, 14)}, n AS (SELECT resume_id, string_agg(job_id, ',' ORDER BY rank) AS negatives FROM best GROUP BY 1)
  SELECT a.item_id::VARCHAR AS resume_id, d.doc_id::VARCHAR AS positive_job_id, coalesce(negatives, '') AS negatives,
  sha256(a.item_id || '|' || d.doc_id) AS sample_id
  FROM benchmark a JOIN embeddings e ON e.vec_id = a.item_id JOIN (SELECT DISTINCT u, j FROM ({LEFT_OUT})) p ON p.u = a.item_id
  JOIN documents d ON d.doc_id = p.j LEFT JOIN n ON n.resume_id = a.item_id WHERE d.text <> ''""")
def _(spark, sf):
    made = mining.build_training_dataset(
        resumes(spark, sf), job_documents(spark, sf), applications(spark, sf), band=BAND)
    return made.select("sample_id", "resume_id", "positive_job_id", F.array_join("hard_negative_job_ids", ",").alias("negatives"))


@query("training_set_size", f"""WITH applied AS (SELECT DISTINCT u, j FROM ({LEFT_OUT}))
  SELECT count(*) AS samples, 1000 AS needed, count(*) >= 1000 AS enough FROM benchmark a JOIN embeddings e ON e.vec_id = a.item_id
  JOIN applied ON u = a.item_id JOIN documents d ON d.doc_id = j WHERE d.text <> '' AND a.text <> ''""")
def _(spark, sf):
    """Whether the training set is large enough."""
    return mining.enough_samples(mining.training_pairs(resumes(spark, sf), job_documents(spark, sf), applications(spark, sf)))
