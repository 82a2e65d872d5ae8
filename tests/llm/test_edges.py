"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, licenses, lines, neardup, packing, pii, quality, rules, shards, toxicity
from pairwright.llm.queries import tokenizer_path
from tests.llm import plain

PROSE = "the quick brown fox jumps over the lazy dog while seven green birds sing of rain and wind in april"
ROWS = [
    (1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \n\n \t"), (5, (PROSE + " 1.2.3.4 a@b.co\n") * 4000), (None, PROSE),
    (None, None), (6, "###"), (7, "one two"), (8, "All rights reserved."), (9, "x" * 100_000), (10, "7" * 60_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 6 else "en", None if i == 7 else f"s{i}", None) for i, t in ROWS]
    extra = [c.strip().rsplit(" ", 1) for c in plain.CLASHING.split(",")]
    return spark.createDataFrame(rows, plain.FIELDS).select("*", *[F.lit(None).cast(k).alias(n) for n, k in extra]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (None, "one two"), (1, PROSE)], "item_id long, text string")


def runs(labels, items):
    return {
        "contained_items": lambda d: decontaminate.contained_items(d, items),
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "quality": lambda d: quality.quality_scores(d, quality.fit_quality(d, labels)),
        "toxicity": lambda d: toxicity.toxicity_scores(d, toxicity.fit_toxicity(d, labels)),
        "rule_report": lambda d: rules.rule_report(d, labels),
        "keep_good": lambda d: rules.keep_good(d, labels),
        "pii": pii.find_personal_data,
        "lines": lines.remove_boilerplate,
        "shards": shards.shard_by_bytes,
        "near_duplicates": neardup.near_duplicates,
        "drop_near": neardup.drop_near_duplicates,
        "licenses": licenses.license_report,
        "pack": lambda d: packing.pack(d, tokenizer_path()),
    }


PER_ROW = ("quality", "toxicity", "rule_report", "pii", "lines", "shards", "near_duplicates", "licenses")
SAME_COLUMNS = ("decontaminate", "keep_good", "lines", "drop_near")
ALL = sorted(runs(None, None))


@pytest.mark.parametrize("name", ALL)
def test_awkward_rows(docs, labels, items, name):
    out = runs(labels, items)[name](docs)
    rows = out.collect()
    if name in PER_ROW:
        assert sorted(str(r[0]) for r in rows) == sorted(str(i) for i, _ in ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in rows)
    if name == "contained_items":
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (5, 1), (None, 1), (7, None)}
    elif name == "decontaminate":
        assert ids == ["10", "2", "3", "4", "6", "8", "9"]
    elif name == "keep_good":
        assert ids == ["1", "1", "None"]  # the long text repeats itself, the others have fewer than 20 words
    elif name == "drop_near":
        assert ids == ["1", "10", "2", "4", "5", "6", "7", "8", "9"]
    elif name == "near_duplicates":
        assert {r.class_id for r in rows if r.doc_id in (2, 3)} == {2}
        assert {(r.doc_id, r.class_id) for r in rows if r.doc_id in (1, None)} >= {(1, 1), (None, 1), (None, 2)}
    elif name == "pack":
        assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(docs, labels, items, name):
    none = docs.limit(0)
    assert runs(labels.limit(0), items.limit(0))[name](none).collect() == []
    if name in ("contained_items", "decontaminate"):
        assert len(runs(labels, items.limit(0))[name](docs).collect()) == (0 if name == "contained_items" else len(ROWS))


def test_no_labels(docs, labels):
    scored = quality.quality_scores(docs, quality.fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in scored} == {0.5} and {r.predicted for r in scored} == {0}
    assert {r.score for r in toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels.limit(0))).collect()} == {0.5}
    assert all(r.kept is False or not r.base_failed for r in rules.rule_report(docs, labels.limit(0)).collect())
