"""Nothing is cut: long tag lists, long terms."""

from pyspark.sql import functions as F

from pairwright.operators import skills
from pairwright.streaming.metrics import parse_statsd


def test_all_tags_are_kept(spark):
    tags = ",".join(f"k{i}:{'v' * 1000}{i}" for i in range(1200))
    line = f"http.requests:1|c|@0.5|#{tags}"
    rows = spark.createDataFrame([(line,)], "value string")
    assert parse_statsd(rows).select(F.size("tags")).first()[0] == 1200


def test_terms_of_any_length(spark):
    docs = spark.createDataFrame([(1, "Our head of data science, and the Head of Data"), (2, None), (3, "")], "doc_id int, text string")
    terms = spark.createDataFrame([("head of data science",), ("Head of",), ("data",), ("",), (None,)], "term string")
    got = {(r.doc_id, r.term, r.position) for r in skills.match_terms(docs, terms).collect()}
    assert got == {(1, "head of data science", 1), (1, "head of", 1), (1, "head of", 7), (1, "data", 3), (1, "data", 9)}
