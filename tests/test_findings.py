"""Cases that reviews found on other rows and larger tables."""

import datetime
import math
import time

import pytest
from pyspark.sql import functions as F

from pairwright.functions.geo import geo_distance
from pairwright.operators import geo, mining, quantiles, ranking, skills, vectors
from pairwright.sources.writers import search_request_rows
from tests.conftest import rows


def test_places_on_the_meridian_are_logged(spark):
    asked = spark.createDataFrame(
        [(1, [(0.0, 5.0)]), (2, [(5.0, 0.0)]), (3, [(None, 5.0)]), (4, [])],
        "user_id long, locations array<struct<latitude: double, longitude: double>>",
    ).withColumns({"time": F.lit(datetime.datetime(2024, 1, 1)), "keywords": F.array(F.lit("a"))})
    got = {r.user_id: r.location for r in search_request_rows(asked).collect()}
    assert got == {1: [0.0, 5.0], 2: [5.0, 0.0], 3: None, 4: None}


def test_age_growth_is_rounded_as_in_c(spark):
    from pairwright.operators.paging import age_growth

    days = spark.range(-50, 5000).select(F.col("id").cast("double").alias("d"))
    got = dict(rows(days.select("d", age_growth(F.col("d")))))
    assert got == {d: math.pow(1.03, d) for d in got}
    odd = spark.createDataFrame([(1e6,), (-1e6,), (None,)], "d double")
    assert [r[0] for r in odd.select(age_growth(F.col("d"))).collect()] == [math.inf, 0.0, None]


def test_counts_are_those_of_the_pairs(spark, monkeypatch):
    """Requests with equal filters and jobs that no filter tells apart meet once."""
    from pairwright.operators import filters

    jobs = spark.range(600).selectExpr(
        "id AS job_id", "concat('t', id % 3) AS title", "if(id % 2 = 0, 'big job', null) AS description",
        "if(id % 5 = 0, 'Mid-level', null) AS experience", "concat('Firm ', id % 200) AS company_name",
        "CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'Rome' WHEN 2 THEN 'Oslo' END AS city",
        "if(id % 3 = 0, 'Italy', 'United States') AS country", "double(id % 4) AS latitude", "double(id % 4) AS longitude")
    bridge = spark.range(600).selectExpr("id AS job_id", "explode(array(id % 7, 1000 + id, 5)) AS field_id")
    rome, near = (None, "Rome", None, None, None), (None, "x", 1.0, 1.0, 120.0)
    kinds = [
        (None, None, None, None, None, None), ([rome], ["JOB"], None, None, None, None), ([near, rome], None, ["Mid-level"], None, None, [3, 5]),
        (None, ["t_"], None, "firm 7", False, None), (None, None, ["Boss"], "firm 1%", True, []), (None, ["none"], None, None, None, [3])]
    asked = spark.createDataFrame(
        [(i, *kinds[i % 6]) for i in range(60)],
        "request_id int, locations array<struct<country:string,city:string,latitude:double,longitude:double,radius_km:double>>, "
        "keywords array<string>, experience array<string>, company string, is_remote_only boolean, fields array<int>")
    want = filters.eligible_pairs(asked, jobs, bridge).groupBy("request_id").agg(F.count("job_id"), F.sum("job_id"))
    met, pairs = [], filters.eligible_pairs
    monkeypatch.setattr(filters, "eligible_pairs", lambda *a, **k: (met.append(pairs(*a, **k)), met[0])[1])
    assert sorted(rows(filters.eligible_counts(asked, jobs, bridge))) == sorted(rows(want))
    asked, jobs = asked.where("request_id % 6 = 0"), jobs.drop("company_name").withColumn("company_name", F.lit("Acme"))
    met.clear()
    assert sorted(rows(filters.eligible_counts(asked, jobs))) == [(i, 600, 179700) for i in range(0, 60, 6)]
    assert met[0].count() <= 120


def test_similar_skills_of_pairs(spark):
    """Similarities are not repeated; a hub's neighbours count only as far as a pair holds them."""
    from pairwright.operators.joins import skill_pair_join

    left = spark.createDataFrame([(i, s) for i in range(40) for s in ("hub", f"own{i}", "both")], "left_id int, skill string")
    right = spark.createDataFrame([(i, s) for i in range(40) for s in (f"s{i}", "both", "s0")], "right_id int, skill string")
    pairs = spark.range(40).selectExpr("int(id) AS left_id", "int(id) AS right_id")
    similar = spark.createDataFrame(
        [("hub", f"s{i}", i / 500) for i in range(500)] + [("hub", "both", 0.9), ("both", "s1", 0.9), ("own3", "s3", 0.5)],
        "skill1 string, skill2 string, similarity double")
    found = skill_pair_join(left, right, pairs, similar)
    want = {(i, i, "hub", f"s{k}", k / 500) for i in range(40) for k in (0, i)} | {(3, 3, "own3", "s3", 0.5)}
    assert sorted(rows(found)) == sorted(want)
    assert "_salt" not in found._jdf.queryExecution().toString()


def test_cut_lineage_writes_parquet(spark):
    from pairwright.session import cut_lineage

    table = spark.createDataFrame([(1, ["a"], None), (2, None, 0.5)], "id int, names array<string>, x double")
    copy = cut_lineage(table)
    assert sorted(rows(copy)) == sorted(rows(table)) and copy.schema == table.schema
    assert all(f.endswith(".parquet") for f in copy.inputFiles()) and copy.inputFiles()


def test_radius_join_on_the_edge_and_spread(spark):
    """Pairs that lie on a radius are decided by the distance itself; few bytes of points still make many tasks."""
    places = spark.range(400).select(
        F.col("id").alias("place_id"), ((F.col("id") * 7919) % 18001 / 100.0 - 90.0).alias("place_latitude"),
        ((F.col("id") * 104729) % 36001 / 100.0 - 180.0).alias("place_longitude"))
    spots = places.select(F.col("place_latitude").alias("latitude"), F.col("place_longitude").alias("longitude"))
    away = geo_distance(F.col("latitude"), F.col("longitude"), F.col("place_latitude"), F.col("place_longitude"))
    radii = F.explode(F.array(*[r / 1000.0 for r in (away, away * (1 - 1e-12), F.lit(0.0), F.lit(2e7), F.lit(3e7), F.lit(-1.0))]))
    asked = spots.limit(40).crossJoin(places.where("place_id % 40 = 3")).select("latitude", "longitude", radii.alias("radius_km"))
    asked = asked.coalesce(1).withColumn("request_id", F.monotonically_increasing_id()).localCheckpoint()
    want = asked.crossJoin(places).where(away <= F.col("radius_km") * 1000.0).select("request_id", "place_id")
    found = geo.geo_radius_join(asked, places)
    got = found.select("request_id", "place_id")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_frequent_first_words_do_not_multiply(spark):
    """Texts that begin alike meet only the terms they hold: pairs of equal first words are never listed."""
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the the "), F.col("id"), F.lit(" and The-"), F.col("id") + 1, F.lit(" ")).alias("text"))
    terms = spark.range(300).select(F.concat(F.lit("The "), F.col("id")).alias("term")).union(
        spark.createDataFrame([("the",), ("the and",), ("and the-301",), ("nowhere",)], "term string"))
    found = skills.match_terms(texts, terms)
    want = {(f"the {i}", i, 1) for i in range(300)} | {(f"the {i + 1}", i, 4) for i in range(299)} | {
        ("the", i, p) for i in range(300) for p in (0, 1, 4)}
    got = rows(found)
    assert len(got) == len(set(got)) and set(got) == want
    counted = rows(skills.count_terms(texts, terms).where("term = 'the'").select("doc_id", "mentions", "first_position"))
    assert sorted(counted) == [(i, 3, 0) for i in range(300)]
    assert "_first" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_reach_words_beyond_the_slices(spark, monkeypatch):
    monkeypatch.setattr(skills, "_SLICE_WORDS", 5)
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d"), (3, " c d e "), (2, "d c d")], "doc_id int, text string").coalesce(1)
    terms = spark.createDataFrame([("c d",), ("c-d",), ("g",), ("d e",)], "term string")
    got = rows(skills.match_terms(texts, terms).select("doc_id", "term", "position"))
    assert sorted(got) == sorted([(1, "c d", 2), (1, "c-d", 2), (1, "d e", 3), (1, "g", 6), (2, "c d", 0), (2, "c-d", 0), (2, "c d", 1),
                                  (2, "c-d", 1), (3, "c d", 1), (3, "c-d", 1), (3, "d e", 2)])


def test_samples_are_counted_without_mining(spark):
    resumes = spark.createDataFrame(
        [(1, 1, "rust code", [1.0, 0.0]), (2, 2, "", [1.0, 0.0]), (3, 3, "go", None), (4, 1, "java", [0.0, 1.0]), (5, 9, "c", [1.0, 1.0])],
        "resume_id long, user_id long, text string, resume_vector array<double>")
    jobs = spark.createDataFrame(
        [(10, "rust", [1.0, 0.5]), (11, "", [1.0, 0.0]), (12, "java code", [0.2, 1.0]), (13, None, None)],
        "job_id long, text string, job_vector array<double>")
    applied = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (1, 12), (2, 10), (3, 12), (1, 77)], "user_id long, job_id long")
    made = mining.build_training_dataset(resumes, jobs, applied)
    pairs = mining.training_pairs(resumes, jobs, applied)
    assert sorted(rows(pairs.select("resume_id", "job_id"))) == [(1, 10), (1, 12), (4, 10), (4, 12)]
    assert sorted((int(r.resume_id), int(r.positive_job_id)) for r in made.collect()) == sorted(rows(pairs.select("resume_id", "job_id")))
    assert "ArrowPython" not in pairs._jdf.queryExecution().toString() and "InArrow" not in pairs._jdf.queryExecution().toString()


def test_percentile_rows_are_not_gathered(spark):
    """Without keys only wanted stretches are shuffled; groups small enough for one task are dealt once."""
    values = spark.range(3000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 1009 / 8.0).alias("v"))
    shares = (0.0, 0.1, 0.5, 0.9, 1.0)

    def joins_of(df):
        df.collect()
        return str(df._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")[0]

    for by in ((), ("g",)):  # the small budget takes the way of large groups
        few = quantiles.exact_percentiles(values, "v", shares, by, row_budget=40)
        all_ = quantiles.exact_percentiles(values, "v", shares, by)
        assert sorted(rows(few)) == sorted(rows(all_)) and all_.count() == (35 if by else 5)
    want = values.groupBy("g").agg(F.expr("percentile(v, 0.9)").alias("value"))
    got = quantiles.exact_percentiles(values, "v", (0.9,), ["g"]).select("g", "value")
    assert sorted((g, round(v, 9)) for g, v in rows(got)) == sorted((g, round(v, 9)) for g, v in rows(want))
    assert "Join" not in joins_of(got)
    whole = quantiles.exact_percentiles(values, "v", shares, row_budget=40)
    wide = [line for line in joins_of(whole).splitlines() if "SortMergeJoin" in line and "_all" in line and "_before" in line]
    logical = whole._jdf.queryExecution().optimizedPlan().toString()
    assert not wide and logical.count("strategy=broadcast") >= 2


def test_pooled_vectors_travel_as_one_row(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12), (3, 99), (4, 13), (5, 14), (5, 10)], "g int, k int")
    known = spark.createDataFrame(
        [(10, [1.0, 2.0]), (11, [4.0, None]), (12, [3.0]), (13, []), (14, None)], "k int, v array<float>")
    pooled = vectors.pool_vectors(members, known, "g", "k", "v", 2)
    got = {r.g: r.v for r in pooled.collect()}
    assert got == {1: [3.0, 2.0], 2: [3.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [1.0, 2.0]}
    assert "Generate" not in pooled._jdf.queryExecution().optimizedPlan().toString()
    long = spark.createDataFrame([(10, [1.0, 2.0, 3.0])], "k int, v array<float>")
    with pytest.raises(Exception, match="longer than 2"):
        vectors.pool_vectors(members, long, "g", "k", "v", 2).collect()


def test_pairs_are_scored_without_carrying_vectors(spark):
    known = spark.createDataFrame(
        [(k, [float(k), 1.0, k / 7]) for k in range(40)] + [(40, None), (3, [9.0, 9.0, 9.0])], "id long, v array<float>")
    queries, items = known.toDF("q", "qv"), known.toDF("i", "iv")
    pairs = spark.range(600).select("id", (F.col("id") * 7 % 43).alias("q"), F.when(F.col("id") % 50 != 9, F.col("id") * 5 % 42).alias("i"))
    want = ranking.biencoder_scores(pairs.join(queries, "q").join(items, "i"), "qv", "iv").select("id", "q", "i", F.round("bi_score", 6))
    for sizes in ({}, {"block_rows": 9, "pair_rows": 5}, {"pair_rows": 40}):
        found = ranking.score_pairs(pairs, queries, items, query_id="q", item_id="i", query_vector="qv", item_vector="iv", **sizes)
        got = found.select("id", "q", "i", F.round("bi_score", 6))
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_skills_are_found_in_retrieved_jobs_only(spark):
    """Text pairs are scored, and a table of skills and skills found on demand give the same rows."""
    from pairwright.plans.retrieval import multi_stage_matches

    resumes = spark.createDataFrame([(1, "rust code", [1.0, 0.0]), (2, "java", [0.0, 1.0])], "resume_id long, text string, resume_vector array<double>")
    jobs = spark.createDataFrame([(i, f"rust word{i}", [1.0, i / 30]) for i in range(60)], "job_id long, text string, job_vector array<double>")
    mine = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "resume_id long, skills array<string>")
    theirs = jobs.select("job_id", F.array(F.when(F.col("job_id") % 2 == 0, "a").otherwise("c")).alias("skills"))
    seen = []

    def wanted(retrieved):
        seen.extend(r.job_id for r in retrieved.collect())
        return theirs.join(retrieved, "job_id", "left_semi")

    table = multi_stage_matches(resumes, jobs, mine, theirs, retrieve=4, keep=3)
    found = multi_stage_matches(resumes, jobs, mine, wanted, retrieve=4, keep=3)
    assert sorted(rows(found)) == sorted(rows(table)) and found.count() == 6
    assert sorted(seen) == [0, 1, 2, 3, 56, 57, 58, 59]


def test_texts_are_not_split_into_rows_of_words(spark):
    """Words are told apart in the bytes of a text; no text becomes an array of strings on its way."""
    texts = spark.createDataFrame(
        [(1, "  Alpha, betaégamma"), (1, "alpha"), (2, ""), (3, "Klingon beta—GAMMA c++"), (4, None), (5, "...")],
        "doc_id long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta gamma",), ("Beta-Gamma",), ("klingon",), ("c++",), ("",), (None,)], "term string")
    found = skills.match_terms(texts, terms)
    assert "split(" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(rows(found.select("doc_id", "term", "position")))
    assert got == sorted([(1, "alpha", 0), (1, "alpha", 1), (1, "beta gamma", 2), (1, "beta-gamma", 2), (3, "beta gamma", 1),
                          (3, "beta-gamma", 1), (3, "c++", 3), (3, "klingon", 0)])


def test_written_steps_leave_no_shuffle_files(spark):
    from pairwright import session

    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {b.split("_")[1] for b in store.getAllBlocks().mkString(" ").split(" ") if b.startswith("shuffle_")}

    held, before = shuffles(), spark.conf.get(session._DROP_SHUFFLES)
    cut = session.cut_lineage(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count())
    assert cut.count() == 7 and spark.conf.get(session._DROP_SHUFFLES) == before
    for _ in range(50):  # files go in a thread of their own
        if len(shuffles() - held) <= 1:
            break
        time.sleep(0.1)
    assert len(shuffles() - held) <= 1  # that of the count
