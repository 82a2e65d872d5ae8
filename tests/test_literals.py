"""Small known cases: calibration, term search, explanations, filters, parsing."""

import pytest
from pyspark.sql import functions as F

from pairwright.functions import scores, text
from pairwright.operators import evaluation, explain, filters, graph, joins, maintenance, skills, terms
from pairwright.operators.mining import mine_combined_negatives, mine_embedding_negatives
from pairwright.streaming.metrics import parse_statsd
from tests.conftest import rows


def one(spark, column, value=None, schema="v double"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize("distance,percent", [
    (0.0, 99.18), (0.1, 97.06), (0.2, 90.0), (0.25, 82.45), (0.3, 71.04), (0.4, 40.06), (0.5, 15.41),
    (-0.1, 100.0), (2.1, 0.0), (None, None),
])
def test_calibration(spark, distance, percent):
    got = one(spark, scores.score_to_percentage(F.col("v")), distance)
    assert got == percent if percent is None else abs(got - percent) < 0.02


@pytest.mark.parametrize("score,label", [
    (1.0, "strong"), (0.8, "strong"), (0.79, "moderate"), (0.5, "moderate"), (0.49, "weak"),
    (0.2, "weak"), (0.19, "missing"), (0.0, "missing"),
])
def test_strength(spark, score, label):
    assert one(spark, scores.score_to_strength(F.col("v")), score) == label


@pytest.mark.parametrize("value,want,kept", [
    ('{Python,SQL,"Machine Learning"}', ["Python", "SQL", "Machine Learning"], 3),
    ("Python, SQL, Machine Learning", ["Python", "SQL", "Machine Learning"], 3),
    ("a,,b", ["a", "b"], 3), (None, [], 0), ("{}", [], 1),
])
def test_skill_strings(spark, value, want, kept):
    assert one(spark, text.parse_skills(F.col("v")), value, "v string") == want
    assert len(one(spark, text.parse_skills_schema(F.col("v")), value, "v string")) == kept


@pytest.mark.parametrize("value,host", [
    ("tacobell.com", "tacobell.com"), ("https://www.tacobell.com/path?x=y", "tacobell.com"),
    ("www.a.org/b", "a.org"), ("", ""), (None, ""),
])
def test_host(spark, value, host):
    assert one(spark, text.extract_host(F.col("v"), strip_www=True), value, "v string") == host


DOCS = [("d1", "python fastapi developer"), ("d2", "python django engineer"), ("d3", "java spring developer")]


def test_term_statistics(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    stats = {r["token"]: r for r in terms.bm25_corpus_stats(docs).collect()}
    assert stats["python"]["df"] == 2
    assert stats["fastapi"]["idf"] > stats["python"]["idf"]


def test_term_search(spark):
    docs = spark.createDataFrame(DOCS + [("d4", "python python python"), ("d5", "")], "doc_id string, text string")
    asked = spark.createDataFrame([("q1", "python"), ("q2", ""), ("q3", "python developer")], "query_id string, text string")
    out = spark.createDataFrame([("q1", "d1"), ("q3", "d4")], "query_id string, doc_id string")
    found = {}
    for q, d, _, rank in rows(terms.bm25_search(asked, docs, 10, excluded=out)):
        found.setdefault(q, {})[rank] = d
    assert found["q1"][1] == "d4" and "d1" not in found["q1"].values()
    assert "q2" not in found and "d4" not in found["q3"].values() and found["q3"][1] == "d1"


@pytest.mark.parametrize("blocks", [(1000, 1000), (1, 2), (3, 1)])
def test_term_search_does_not_depend_on_blocks(spark, blocks):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} common tail{i}") for i in range(40)], "doc_id int, text string")
    asked = spark.createDataFrame([(i, f"word{i} common word{i + 1}") for i in range(6)], "query_id int, text string")
    whole = rows(terms.bm25_search(asked, docs, 5))
    cut = rows(terms.bm25_search(asked, docs, 5, query_block_rows=blocks[0], index_block_rows=blocks[1]))
    assert sorted(whole) == sorted(cut) and len(whole) == 30


VECTORS = [("job1", [1.0, 0.0, 0.0]), ("job2", [0.0, 1.0, 0.0]), ("job3", [0.9, 0.1, 0.0]),
           ("job4", [0.0, 0.0, 1.0]), ("job5", [0.8, 0.2, 0.0]), ("job6", None)]


def test_negatives(spark):
    jobs = spark.createDataFrame([(j, f"python {j}", v) for j, v in VECTORS], "job_id string, text string, job_vector array<double>")
    resumes = spark.createDataFrame([("r", "python job6", [1.0, 0.0, 0.0])], "resume_id string, text string, resume_vector array<double>")
    positives = spark.createDataFrame([("r", "job1")], "resume_id string, job_id string")
    near = rows(mine_embedding_negatives(resumes, jobs, positives, 3, (0.1, 1.0)))
    assert [r[1] for r in sorted(near, key=lambda r: r[3])] == ["job3", "job5"]
    assert rows(mine_embedding_negatives(resumes, jobs, positives, 3, (0.1, 0.95))) == []
    both = mine_combined_negatives(resumes, jobs, positives, 3, (0.1, 1.0)).orderBy("rank").collect()
    assert [r["rank"] for r in both] == [1, 2, 3] and "job1" not in [r["job_id"] for r in both]
    assert both[0]["combined_score"] >= both[1]["combined_score"] >= both[2]["combined_score"]


def explained(spark, **values):
    schema = ("resume_skills array<string>, job_skills array<string>, resume_level string, resume_years int, "
              "resume_location string, job_level string, job_years int, job_location string, is_remote boolean, "
              "overall_score double, related_skills array<struct<similarity:double,skill1:string,skill2:string>>")
    names = [part.strip().split(" ")[0] for part in schema.replace("struct<similarity:double,skill1:string,skill2:string>", "s").split(", ")]
    row = tuple(values.get(n) for n in names)
    return explain.explain_batch(spark.createDataFrame([row], schema)).first()


def test_explanations(spark):
    strong = explained(spark, resume_skills=["python", "aws"], job_skills=["python", "sql"], overall_score=0.85,
                       resume_level="senior", resume_years=8, job_level="senior", job_years=5,
                       resume_location="San Francisco, CA", job_location="San Jose, CA", is_remote=False)
    assert strong["overall_strength"] == "strong"
    assert strong["skill_explanation"]["matched_skills"] == ["python"]
    assert strong["skill_explanation"]["missing_skills"] == ["sql"]
    assert strong["experience_explanation"]["match_score"] >= 0.8
    assert strong["location_explanation"]["match_score"] == 0.8
    weak = explained(spark, resume_skills=[], job_skills=[], overall_score=0.35, resume_level="entry", resume_years=1,
                     job_level="senior", job_years=5, job_location="Paris", resume_location="Rome", is_remote=True)
    assert weak["overall_strength"] == "weak" and weak["experience_explanation"]["match_score"] < 0.5
    assert weak["location_explanation"]["match_score"] == 1.0
    assert weak["skill_explanation"]["match_score"] == 0.5
    bare = explained(spark, resume_skills=["a"], job_skills=[], overall_score=0.5)
    assert bare["experience_explanation"] is None and bare["location_explanation"] is None


def test_location_column(spark):
    jobs = spark.createDataFrame([
        (1, "New York", "United States", 40.7, -74.0), (2, "remote", "United States", None, None),
        (3, "Boston", "United States", 42.36, -71.06), (4, "remote", "Italy", None, None), (5, None, None, None, None),
    ], "id int, city string, country string, lat double, lon double")
    def ids(locations):
        keep = filters.location_matches(locations, F.col("city"), F.col("country"), F.col("lat"), F.col("lon"))
        return sorted(r[0] for r in jobs.where(keep).select("id").collect())

    assert ids([{"country": "USA", "city": "New York"}]) == [1, 2]
    assert ids([{"latitude": 40.7128, "longitude": -74.006, "radius_km": 5.0, "city": "Boston"}]) == [1, 2, 4]
    assert ids([]) == [1, 2, 3, 4, 5] and ids([{}]) == [1, 2, 3, 4, 5]


def test_request_table_filters_match_single_request(spark):
    jobs = spark.createDataFrame([
        (i, f"t{i}", None, ["Internship", "Mid-level", None][i % 3], "Acme", ["remote", "Rome", "Oslo", None][i % 4],
         ["Italy", "United States", None][i % 3], float(i % 90), float(i * 7 % 360 - 180)) for i in range(120)
    ], "job_id int, title string, description string, experience string, company_name string, city string, country string, latitude double, longitude double")
    locations = [{"country": "USA", "city": None, "latitude": None, "longitude": None, "radius_km": None},
                 {"country": None, "city": "Rome", "latitude": None, "longitude": None, "radius_km": None},
                 {"country": None, "city": "x", "latitude": 10.0, "longitude": 20.0, "radius_km": 6000.0}]
    asked = spark.createDataFrame(
        [(1, locations, ["t1"], ["Mid-level", "Boss"], None, False, None), (2, locations[:1], None, ["Boss"], "ACME", None, []), (3, None, None, None, None, None, None)],
        "request_id int, locations array<struct<country:string,city:string,latitude:double,longitude:double,radius_km:double>>, "
        "keywords array<string>, experience array<string>, company string, is_remote_only boolean, fields array<int>")
    got = sorted(rows(filters.eligible_pairs(asked, jobs)))
    where = lambda locs: filters.location_matches(locs, F.col("city"), F.col("country"), F.col("latitude"), F.col("longitude"))
    one_ = jobs.where(where(locations) & (F.col("experience") == "Mid-level") & F.col("title").contains("t1"))
    want = [(1, r["job_id"]) for r in one_.collect()] + [(2, r["job_id"]) for r in jobs.where(where(locations[:1])).collect()]
    assert got == sorted(want + [(3, i) for i in range(120)])


def test_id_checks(spark):
    good = "123e4567-e89b-12d3-a456-426614174000"
    jobs = spark.createDataFrame([(good,)], "job_id string")
    asked = spark.createDataFrame([(good, 1), (good.upper(), 2), ("nope", 3)], "asked_id string, position int")
    assert [r["asked_id"] for r in joins.validate_job_ids(asked, jobs).collect()] == ["nope", good.upper()]
    assert joins.jobs_by_ids(jobs, asked).count() == 1


def test_seed_graph(spark):
    known, relations = graph.default_taxonomy(spark)
    edges = graph.skill_edges(relations)
    assert known.count() == 53
    pairs = spark.createDataFrame([
        ("python", "python"), ("react", "vue"), ("django", "python"), ("python", "django"), ("nlp", "python"),
        ("java", "rust"), ("python", "docker"), ("python", "cobol"), ("django", "fastapi")], "skill1 string, skill2 string")
    got = {(r[0], r[1]): round(r[2], 4) for r in rows(graph.skill_similarity(pairs, known, edges))}
    assert got == {("python", "python"): 1.0, ("react", "vue"): 0.7, ("django", "python"): 0.9, ("python", "django"): 0.0,
                   ("nlp", "python"): 0.32, ("java", "rust"): 0.3, ("python", "docker"): 0.0, ("python", "cobol"): 0.0,
                   ("django", "fastapi"): 0.7}
    seeds = spark.createDataFrame([("nlp",), ("vue",)], "seed string")
    reached = {(r[0], r[1]): round(r[2], 4) for r in rows(graph.related_skills(seeds, edges))}
    assert reached[("nlp", "machine-learning")] == 0.8 and reached[("nlp", "python")] == 0.64
    assert reached[("vue", "react")] == 0.7 and ("nlp", "java") not in reached
    names = spark.createDataFrame([("K8S",), ("google cloud",), ("Python",), ("nothing",)], "name string")
    ids = dict(rows(graph.skill_lookup(names, known)))
    assert ids == {"K8S": "kubernetes", "google cloud": "gcp", "Python": "python", "nothing": None}


def test_rejection_log(spark):
    log = spark.createDataFrame(
        [(1, "a", "pass", 1, 1), (1, "a", "pass", 2, 2), (1, "b", "pass", 1, 3), (1, "b", "undo", 2, 4),
         (1, "c", "pass", 1, 5), (1, "c", "undo", 2, 6), (1, "c", "pass", 3, 7)],
        "user_id int, job_id string, action string, timestamp int, seq int")
    assert sorted(rows(maintenance.apply_rejections(log))) == [(1, "a", 1), (1, "c", 3)]


def test_metrics_of_unretrieved_queries(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, item_id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z"), ("lost", "y")], "query_id string, item_id string")
    got = {r["query_id"]: r for r in evaluation.query_metrics(ranking, relevant).collect()}
    assert got["q"]["mrr"] == 0.5 and got["q"]["average_precision"] == 0.25
    assert got["q"]["recall_at_5"] == 0.5 and got["q"]["precision_at_5"] == 0.2
    assert got["lost"]["mrr"] == 0.0 and got["lost"]["ndcg_at_10"] == 0.0


def test_metric_lines(spark):
    lines = spark.createDataFrame([
        ("http.requests:1|c|@0.5|#method:GET,route:/jobs",), ("bad",), ("a:x|c",), ("a:1",), ("a:2|g",), ("a:2|zz",)], "value string")
    got = parse_statsd(lines).collect()
    assert [(r["name"], r["metric_value"], r["type"], r["sample_rate"]) for r in got] == [
        ("http.requests", 1.0, "c", 0.5), ("a", 2.0, "g", 1.0)]
    assert got[0]["tags"] == {"method": "GET", "route": "/jobs"}


def test_skill_mentions(spark):
    text_ = "Senior dev: Python, python and PYTHON3. Uses node.js, C++ and Google Cloud. Skills: kubernetes, teamwork and cobolx."
    docs = spark.createDataFrame([(1, text_), (2, ""), (3, None)], "doc_id int, text string")
    got = {r["skill"]: r for r in skills.extract_skills(docs).collect()}
    assert got["python"]["name"] == "Python" and got["python"]["start_pos"] == text_.index("Python")
    assert got["python"]["aliases"] == ["python", "PYTHON3"]
    assert got["nodejs"]["name"] == "node.js" and got["gcp"]["end_pos"] == text_.index("Google Cloud") + 12
    # a listed item takes the first known name inside it, here the one-letter language
    assert (got["r"]["name"], got["r"]["confidence"], got["r"]["start_pos"]) == ("kubernetes", 0.8, -1)
    assert got["cpp"]["name"] == "C" and got["kubernetes"]["confidence"] == 0.95
