"""Best-k search in stripes: equal rows, bounded kernel output, k of each query's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import blocks, terms, vectors
from pairwright.session import scratch_path
from pairwright.sources.readers import saved_index
from pairwright.sources.writers import save_index
from tests.conftest import rows

N_QUERIES, N_ITEMS, K = 40, 2000, 25


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    def side(n, name):
        data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 6)))]
        return spark.createDataFrame(data, f"{name}_id long, {name}_vector array<double>")
    return side(N_QUERIES, "query"), side(N_ITEMS, "item")


@pytest.fixture(scope="module")
def single(sides):
    return sorted(rows(vectors.vector_topk_join(*sides, K)))


@pytest.mark.parametrize("stripes", [3, 40])
def test_stripes_give_the_same_rows(sides, single, stripes):
    found = vectors.vector_topk_join(*sides, K, item_block_rows=-(-N_ITEMS // stripes))
    assert sorted(rows(found)) == single


def test_blocks_return_little_more_than_k_rows(sides, monkeypatch, spark):
    """Rows that leave the kernel in the second pass; without a bound it would be k for each of 40 blocks."""
    seen = []
    kept = blocks.top_k
    monkeypatch.setattr(blocks, "top_k", lambda df, *a: (seen.append(df.count()), kept(df, *a))[1])
    vectors.vector_topk_join(*sides, K, item_block_rows=N_ITEMS // 40).count()
    assert N_QUERIES * K <= seen[0] <= N_QUERIES * K * 1.3


@pytest.mark.parametrize("stripes", [1, 8])
def test_every_query_has_its_own_k(sides, single, stripes):
    queries, items = sides
    own = F.when(F.col("query_id") == 7, 25).when(F.col("query_id") == 8, 0).otherwise(3)
    found = vectors.vector_topk_join(queries.withColumn("want", own), items, "want", item_block_rows=N_ITEMS // stripes)
    want = {7: 25, 8: 0}
    ranked = {(r[0], r[1]): r for r in single}
    assert sorted(rows(found)) == sorted(r for r in ranked.values() if r[-1] <= want.get(r[0], 3))


def test_band_exclusions_and_segments_hold_in_stripes(spark, sides):
    queries, items = (s.withColumn("part", F.col(s.columns[0]) % 2) for s in sides)
    out = spark.range(0, 400).select((F.col("id") % N_QUERIES).alias("query_id"), (F.col("id") * 5).alias("item_id"))
    search = dict(band=(0.1, 0.8), excluded=out, segment="part")
    one = vectors.vector_topk_join(queries, items, K, **search).select("query_id", "item_id", "distance", "rank")
    many = vectors.vector_topk_join(queries, items, K, item_block_rows=60, **search).select("query_id", "item_id", "distance", "rank")
    assert sorted(rows(one)) == sorted(rows(many)) and one.count() > 0


def test_terms_in_stripes(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}x" for i in range(60)]
    texts = [(i, " ".join(rng.choice(words, 30))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(i, t[:40]) for i, t in texts[:30]] + [(99, "absent")], "query_id long, text string")
    one = sorted(rows(terms.bm25_search(asked, docs, 9)))
    assert sorted(rows(terms.bm25_search(asked, docs, 9, index_block_rows=200, query_block_rows=40))) == one


def test_postings_go_only_to_blocks_that_ask(spark):
    """A block of queries gets no posting of a token that none of them holds."""
    docs = spark.createDataFrame([(i, "common " + f"rare{i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"rare{i}") for i in range(4)], "query_id long, text string")
    index, stats = terms.build_index(docs)

    def kernel(left, right, sketch):
        return blocks.result_table("", ("query_id", "doc_id", "s"), right.column("doc_id"), right.column("doc_id"), [1.0] * right.num_rows)
    found = blocks.blocked_top_k(terms.query_terms(asked, stats), index.select("doc_id", "token", "impact"), kernel, 99,
                                 query_id="query_id", item_id="doc_id", score="s", shared="token")
    assert found.count() == 4


def test_a_saved_index_is_joined_where_it_lies(spark):
    docs = spark.createDataFrame([(i, f"common rare{i} word{i % 3}x") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare7 common"), (2, "word1x")], "query_id long, text string")
    save_index(*terms.build_index(docs), "kept", scratch_path(spark, "kept"), 4)
    index, stats = saved_index(spark, "kept")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        found = terms.bm25_search(asked, docs, 5, index=index, stats=stats)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        got = sorted(rows(found))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == sorted(rows(terms.bm25_search(asked, docs, 5)))
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "kept_index" in line]
    assert scans
    for at in scans:
        level, above = depth(plan[at]), []
        for line in reversed(plan[:at]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        joined = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:joined])


@pytest.mark.parametrize("stripe", [400, 30])
def test_pairs_of_an_owner_and_carried_columns(spark, stripe):
    """Against plain numpy: pairs given once for all queries of an owner, ties, vectors without length or with NaN, own k."""
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(400, 5)), 1)
    items[50:60], items[7], items[8, 0] = items[3], 0.0, np.nan
    asked = np.round(rng.normal(size=(70, 5)), 1)
    asked[9] = items[3]
    out = {(q, i) for q in range(6) for i in range(q * 31, q * 31 + 90)}
    queries = spark.createDataFrame(
        [(i, i % 7 if i % 7 < 6 else None, i % 4 * 5, v.tolist()) for i, v in enumerate(asked)], "query_id long, user_id int, want int, query_vector array<double>")
    things = spark.createDataFrame([(i, f"n{i}", v.tolist()) for i, v in enumerate(items)], "item_id long, name string, item_vector array<double>")
    pairs = spark.createDataFrame(sorted(out), "user_id int, item_id long")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    base, want = unit(items), []
    for q, v in enumerate(unit(asked)):
        lost = [(round(1 - float(v @ base[i]), 9), i) for i in range(400) if i != 8 and (q % 7, i) not in out]
        want += [(q, i, f"n{i}", round(d, 6), r) for r, (d, i) in enumerate(sorted(lost)[:q % 4 * 5], 1)]
    found = vectors.vector_topk_join(queries, things, "want", excluded=pairs, excluded_by="user_id", carry=["name"],
                                     item_block_rows=stripe, query_block_rows=stripe)
    assert sorted(rows(found.select("query_id", "item_id", "name", F.round("distance", 6), "rank"))) == sorted(want)


def test_exclusions_are_not_multiplied_by_requests(spark):
    from pairwright.plans.match import excluded_pairs

    requests = spark.range(500).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("user_id"))
    none = spark.createDataFrame([], "user_id long, job_id long")
    applied = spark.range(300).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("job_id"))
    assert excluded_pairs(requests, applied, none, none.select("job_id"))[0].count() == 200


def test_tokens_are_counted_where_they_lie(spark, monkeypatch):
    from collections import Counter

    texts = {i: " ".join(f"w{j % (i % 9 + 1)}x" for j in range(i % 40)) for i in range(200)} | {200: None, 201: "", 202: "the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(terms, "_ROWS_PER_COUNT", 7)
    found = terms.term_counts(docs)
    want = [(i, len(t.split()), w, n) for i, t in texts.items() if t and i < 200 for w, n in Counter(t.split()).items()]
    assert sorted(rows(found)) == sorted(want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_stripes_are_searched_by_groups(spark, monkeypatch):
    """A bound from the nearest item of each group loses no row, gives few more, and no whole stripe is partitioned."""
    rng = np.random.default_rng(6)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6000, 4)))], "item_id long, item_vector array<double>")
    queries = items.where("item_id < 20").toDF("query_id", "query_vector")
    one = sorted(rows(vectors.vector_topk_join(queries, items, 3, item_block_rows=6000)))
    monkeypatch.setattr(vectors, "_PER_GROUP", 8)
    assert sorted(rows(vectors.vector_topk_join(queries, items, 3, item_block_rows=3000))) == one
    base = np.random.default_rng(7).normal(size=(3000, 4))
    import pyarrow as pa
    left = pa.table({"_seg": [""] * 2, "query_id": [0, 1], "query_vector": base[:2].tolist(), "_k": pa.array([3, 3], pa.int32()),
                     "_bound": pa.array([None, None], pa.float64()), "_stripes": [2, 2], "_out": pa.array([None, None], pa.int64())})
    right = pa.table({"item_id": list(range(3000)), "item_vector": base.tolist()})
    widths, cut = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *r, **o: (widths.append(a.shape[1]), cut(a, *r, **o))[1])
    vectors.cosine_kernel("query_id", "item_id", "query_vector", "item_vector", "d")(left, right, True)
    assert widths and max(widths) <= 3000 // 8
