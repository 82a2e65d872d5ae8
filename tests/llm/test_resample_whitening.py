"""Resampling and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import resample as R
from pairwright.llm.whitening import bit_sliced_products, whiten


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, runs):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % R.BUCKETS for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, runs=1, share=10):
    s = Counter(b for _, t in docs for b in plain_features(t, runs))
    t = Counter(b for x in target for b in plain_features(x, runs))
    S, T, m = sum(s.values()), sum(t.values()), R.BUCKETS
    rows = []
    for doc, text in docs:
        found = plain_features(text, runs)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (S + m)) / ((s[b] + 1) * (T + m)))) for b in found)
        h = int(hashlib.sha256(f"{R.SEED}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
                     len(plain_words(text)) >= R.LEAST_WORDS])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed, n=300):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdéXYZ09") for _ in range(draw.randrange(1, 9))) for _ in range(80)] + ["q" * 70, "é" * 90]
    gaps = [" ", "  ", ", ", "\n", "-", "\x7f"]
    return [(i, "".join(draw.choice(vocabulary) + draw.choice(gaps) for _ in range(draw.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("runs", [1, 2])
def test_resample_equals_brute_force(spark, runs):
    docs = corpus(1) + [(None, "one " * 30), (900, None), (901, ""), (7, "one two"), (8, "x" * 5000)]
    target = [t for _, t in corpus(2, 20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df, goal, share_pct=30, run_words=runs, pivots=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, runs, 30)


def test_equal_keys_fill_the_draw_exactly(spark):
    docs = [(1, "same words " * 20)] * 50 + [(2, "other words " * 20)] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for share in (0, 13, 50, 100):
        ranks = sorted(r.rank for r in R.resample(df, df.limit(1), share_pct=share, pivots=2).collect() if r.rank)
        assert ranks == list(range(1, share + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(empty, empty).collect() == []
    assert [r.weight for r in R.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).collect()] is not None
    assert whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).collect() == []


def test_kth_key_finds_every_place(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(5), draw.choice([None, *range(9)]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 30, 59, 60):
        key = spark.range(1).select(R.kth_key(df, k, 4).alias("k")).first().k
        assert (-key.score, key.doc_id, key.row) == order[k - 1]


def test_bit_slices_are_exact():
    rng = np.random.default_rng(1)
    rows = rng.integers(-2 ** 40, 2 ** 40, (200, 5))
    low, products = bit_sliced_products(rows)
    offsets = [[int(x) - m for x, m in zip(r, low, strict=True)] for r in rows.tolist()]
    for i in range(5):
        for j in range(i, 5):
            assert products[i][j] == sum(o[i] * o[j] for o in offsets)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(500, [float(x) for x in base[0]])] * 3
    rows += [(None, [float(x) for x in base[1]]), (601, None), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6),
             (604, [float("inf")] * 6), (605, [1.0, 2.0]), (606, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).repartition(4)
    got = whiten(df, components=4).collect()
    x = np.floor(64 * base.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    exact = [[Fraction(int(n * (fit[:, i] * fit[:, j]).sum() - sums[i] * sums[j]), n * n) for j in range(6)] for i in range(6)]
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in r] for r in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == (150 + 3 + 1) * 4 and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for i in range(150):
        z = (x[i] - sums / n) @ vectors / np.sqrt(values)
        assert by[i, 1].deviation == int(((n * x[i] - sums) ** 2).sum())
        for k in range(4):
            r = by[i, k + 1]
            sign.setdefault(k, 1 if r.whitened * z[k] > 0 else -1)
            assert r.whitened == pytest.approx(sign[k] * z[k], abs=1e-8)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9
    assert by[500, 1].whitened == by[0, 1].whitened and by[None, 2].whitened == by[1, 2].whitened


def test_constant_vectors(spark):
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [
        (1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 0, 0.0, 0.0, 1.0)] * 2
