"""The pipeline against its stages in plain Python, and the queries with SQL against DuckDB."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from pairwright.llm.packing import _encoder
from pairwright.llm.queries import QUERIES, SQL, tokenizer_path
from tests.llm import plain
from tests.llm.test_methods import sentence

FOLDER = "/root/testdata/sf0.001"


def expected(docs, items):
    """Documents after the first four stages; no label is in the tables, so rules beyond the base are off."""
    rows = [r for r in docs if not plain.base_failed(r[1])]
    rows = plain.without_boilerplate(rows, 10)
    group = plain.classes([t for _, t, _ in rows])
    least = {}
    for i, t, _ in rows:
        least[group[t or ""]] = min(i, least.get(group[t or ""], i))
    rows = [r for r in rows if least[group[r[1] or ""]] == r[0]]
    leaked = {d for d, _ in plain.contained([(i, t) for i, t, _ in rows], items)}
    return [(i, t) for i, t, _ in rows if i not in leaked]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, sentence(rng, 14)) for i in range(5)]
    docs = []
    for i in range(140):
        lines = [sentence(rng, rng.randint(4, 30)) for _ in range(rng.randint(0, 6))]
        if i % 3 == 0:
            lines.insert(0, "subscribe to our letter and read on")
        if i % 11 == 0:
            lines.append("so " + rng.choice(items)[1] + " indeed")
        if i % 13 == 0 and docs:
            lines = docs[rng.randrange(len(docs))][1].split("\n") + ["one more"] * (i % 2)
        if i % 17 == 0:
            lines = ["again and again and once more we say it"] * 9
        docs.append((i, "\n".join(lines), f"s{i % 12}"))
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], plain.FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = _encoder(tokenizer_path()).tokenizer, {}
    kept = expected(docs, items)
    for i, text in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in got} == want
    assert 40 < len(kept) < 125
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= plain.first_fit_decreasing([n for n, _ in want.values()], 2048) + 1


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) and "pipeline" in queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    message, _, good = check.compare(spark, sql, FOLDER, name, QUERIES[name], SQL[name])
    assert good, message


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
@pytest.mark.parametrize(("name", "label", "modulus", "rest"), [
    ("op2_compression_quality", "quality", 4, 2), ("op3_counterfactual_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == rest for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.9
    assert scored.where(~F.col("score").between(0, 1)).isEmpty()
