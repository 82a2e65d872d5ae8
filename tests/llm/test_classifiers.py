"""The classifiers' fits on Spark: whole texts, one row an id, groups learnt from the corpus."""

import random

import pytest

from pairwright.llm import quality, samples, toxicity


def corpus(spark, seed=3):
    """Texts of common words; toxic ones hold an insult, and by chance more of the word ``nord`` than of its like ``west``."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        lines = []
        for _ in range(6):
            place = "nord" if rng.random() < (0.6 if toxic else 0.45) else "west"
            lines.append(f"the {place} of the {rng.choice(['house', 'river', 'road'])} is {rng.choice(['old', 'new'])}")
        if toxic:
            lines.insert(rng.randrange(6), f"what a rotten {rng.choice(['road', 'house'])}")
        docs.append((i, ". ".join(lines)))
        labels.append((i, int(toxic), int(not toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = corpus(spark)
    return docs.cache(), labels.cache()


def trained_rows(docs, labels):
    rows = docs.join(labels, "doc_id").where(samples.id_bucket(docs["doc_id"], 3) != 1).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.toxic for r in rows]


def test_fit_equals_the_plain_one(made):
    groups = (("nord", "west"), ("house", "river", "road"))
    got = toxicity.fit_toxicity(*made, groups=groups, learn=False)
    want = toxicity.train(*trained_rows(*made), groups=groups)
    assert got.pairs == want.pairs > 0 and got.change == pytest.approx(want.change, abs=1e-4)
    names = set(got.weights) | set(want.weights)
    assert all(abs(got.weights.get(n, 0) - want.weights.get(n, 0)) < 1e-3 for n in names)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-3)


def test_changes_are_those_of_sentence_pairs(made):
    groups = (("nord", "west"),)
    texts, _ = trained_rows(*made)
    names = ["nord$", "west$", "nord", "house$", "of$"]
    index = {n: j for j, n in enumerate(names)}
    pairs, sums = toxicity._changes(texts, index, groups)
    plain = [s for t in texts for s in t.split(".") if "nord" in s.split() or "west" in s.split()]
    assert pairs == 2 * len(plain)  # two shifts; with two terms the second one changes nothing
    value = round(1 / toxicity.UNIT)  # the density of a word of a short sentence is full
    assert sums[0, 0] == sum(s.split().count("nord") + s.split().count("west") for s in plain) * value ** 2
    assert sums[0, 1] == -sums[0, 0] and (3, 3) not in sums and (4, 4) not in sums


def test_words_of_one_place_form_a_group_and_stop_moving_the_score(made):
    fair = toxicity.fit_toxicity(*made, groups=())
    assert any({"old", "new"} <= set(g) for g in fair.groups), fair.groups
    assert not any("rotten" in g for g in fair.groups)
    loose = toxicity.fit_toxicity(*made, groups=(("nord", "west"),), learn=False, penalty=0.0)
    tied = toxicity.fit_toxicity(*made, groups=(("nord", "west"),), learn=False)
    assert loose.change > 0 and tied.change < 0.2 * loose.change and tied.weights["rotten$"] > 0


def test_rows_and_labels_of_an_id_count_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, "d"), (4, "x" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    ids = samples.labelled_ids(labels, "toxic", labels["doc_id"] > 0, 10)
    rows = samples.sampled_texts(docs, ids).collect()
    assert sorted((r.doc_id, r.y, len(r.text)) for r in rows) == [(1, 1, 0), (3, 0, 1), (4, 1, 50_000)]
    assert samples.labelled_ids(labels, "toxic", labels["doc_id"] > 0, 1).count() == 2


def test_toxic_words_far_inside_a_text_train(spark):
    filler = "the house is old. " * 4000
    docs = spark.createDataFrame([(i, filler + "rotten " * 3000 * (i % 2) + filler) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.toxicity_scores(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_quality_calibrates_on_whole_texts(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "river", "runs", "along", "old", "road"]) for _ in range(400)) for _ in range(30)]
    bad = [" ".join(rng.choice(["###", "$$$", "buy", "now", "xx", "%%"]) for _ in range(400)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.quality_scores(docs, model).where("held_out").collect()
    assert got and all(r.predicted == int(r.doc_id < 30) for r in got)
