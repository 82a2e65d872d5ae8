"""The corpus operators against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, licenses, lines, neardup, packing, pii, rules, shards, toxicity
from pairwright.llm.components import components
from pairwright.llm.queries import tokenizer_path
from tests.llm import plain

VOCABULARY = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto") for b in ("ta", "ren", "vi", "dok", "sel", "an")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.choice([1, 2, 3, 4, 5, 6, 12, 30, 80]))) for i in range(25)] + [(90, sentence(rng, 700))]
    docs = []
    for d in range(120):
        own = sentence(rng, rng.randint(0, 150)).split()
        if rng.random() < 0.7:
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
                part[rng.randrange(len(part))] = "zzz"
            at = rng.randint(0, len(own))
            own[at:at] = part
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(own).upper() if d % 2 else " ".join(own)))
    found = decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain.contained(docs, items)
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in found} == want and len(want) > 20


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    elements = rng.integers(-2**62, 2**62, 40)
    for top in (1, 6, 300):
        a, b = rng.integers(0, top + 1, 40), rng.integers(0, top + 1, 40)
        a[0] = b[0] = 1
        both = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        bags = [(np.full((w > 0).sum(), i), elements[w > 0].view(np.uint64), w[w > 0]) for i, w in enumerate((a, b))]
        owner, element, weight = (np.concatenate(x) for x in zip(*bags, strict=True))
        times = neardup.bag_signatures(owner, element, weight, 2, 4000)
        assert np.isfinite(times).all()
        assert abs((times[0] == times[1]).mean() - both) < 0.05


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for group in range(12):
        base = sentence(rng, rng.randint(3, 90)).split()
        for _ in range(rng.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += rows[:6] + ["", "a", "A!", "a b", "loop de loop de " * 40, "loop de loop de " * 44]
    rows = [(i, t) for i, t in enumerate(rows)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain.classes([t for _, t in rows])
    least = {}
    for i, t in rows:
        least[want[t]] = min(i, least.get(want[t], i))
    assert {r.doc_id: r.class_id for r in got} == {i: least[want[t]] for i, t in rows}
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


def test_copies_without_their_original(spark):
    """Copies edited at two to four places each, so that some are alike and many that meet in buckets are not."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(146)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(146), rng.choice([1, 1, 2, 2, 3, 4])):
            copy[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, least = plain.classes([t for _, t in rows]), {}
    for i, t in rows:
        least[want[t]] = min(i, least.get(want[t], i))
    assert {r.doc_id: r.class_id for r in got} == {i: least[want[t]] for i, t in rows} and len(least) > 5


def test_components_close_long_chains(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("x", "y"), ("z", "y")]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a string, b string")).collect())
    assert {got[f"n{i:03}"] for i in range(71)} == {"n000"} and got["z"] == got["y"] == "x"


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    common = ["menu", "cookie notice", "  footer", "été"]
    rows = [(i, "\n".join(rng.choice(common + [f"own {i} {j}", ""]) for j in range(rng.randint(0, 9))), f"s{rng.randrange(7)}")
            for i in range(60)] + [(60, None, "s1"), (61, "menu\nmenu", None)]
    for sites in (2, 6, 7):
        got = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites).collect()
        assert sorted(map(tuple, got)) == sorted(plain.without_boilerplate(rows, sites))


@pytest.mark.parametrize("fetch", [50_000, 3])
def test_shards_are_minimax(spark, monkeypatch, fetch):
    monkeypatch.setattr(shards, "FETCH", fetch)
    monkeypatch.setattr(shards, "BLOCK_DIGITS", 1)
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(0, 40)) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(700)] + [(700 + i, "hot " * 30) for i in range(200)] + [(900, None)]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, of, slots = {}, {}, {}
    text = dict(rows)
    groups = {}
    for r in got:
        t = text[r.doc_id] or ""
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes"
        assert of.setdefault(t, r.shard) == r.shard
        groups[t] = groups.get(t, 0) + r.size
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    order = sorted(groups, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert max(sizes.values()) <= plain.smallest_capacity([groups[t] for t in order], 24)
    assert [of[t] for t in order] == sorted(of[t] for t in order) and set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 40, 300, 900) for k in (0, 1, 3, 5, 17) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for r in got.collect():
        if r.k >= r.n * 0.02:
            assert r.p == 1.0
        else:
            assert r.p == pytest.approx(plain.binomial_tail(r.k, r.n, 0.02), rel=1e-9)


def test_rules_bound_false_rejections(spark):
    """Bad documents are full of signs; good ones of one stratum hold some too, so its cutoff has to stay above them."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(2400):
        good, lang = i % 4 != 0, "en" if i % 2 else "xx"
        share = (0.3 if lang == "xx" and rng.random() < 0.1 else 0.0) if good else 0.9
        rows.append((i, " ".join(w + "#" if rng.random() < share else w for w in sentence(rng, 60).split()), lang))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    report = rules.rule_report(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    quality = dict(labels)
    for lang in ("en", "xx"):
        good = [r for r in report if r.stratum == lang and quality[r.doc_id] == 1]
        bad = [r for r in report if r.stratum == lang and quality[r.doc_id] == 0]
        assert sum(not r.kept for r in good) <= rules.RISK * len(good)
        assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert len(rules.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()) == sum(r.kept for r in report)


def test_personal_data_equals_brute_force(spark):
    texts = [
        None, "", "a@b.c_d@e.f.g x@y z.@q-.a.b..c 1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.3.255 999",
        "\U0001f600é +1 (437) 555-0689 and +49 30 1234567 4526830644432327 4111-1111-1111-1111 4111 1111 1111 1111 2",
        "1" * 5000 + " " + "a" * 5000 + "@" + "b." * 3000 + "c", "+1" + " 2" * 4000, "5-" * 20_000,
    ]
    rng = random.Random(6)
    texts += ["".join(rng.choice("0123456789.@+ -ab_%()") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    rows = list(enumerate(texts))
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), least=10**9).collect():
        spans = plain.personal(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.spans == listed and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in plain.PII]


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(9)
    rows = [(i, f"{sentence(rng, 5)} call me on +49 30 {rng.randrange(10**6, 10**7)} today") for i in range(30)]
    rows += [(100, "please call me on 0304455667 today"), (101, "room 4455667 is free"), (102, "call me on monday 5 today")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:18:28" and got[100].n_phone == 0
    assert got[101].spans == got[102].spans == "" and got[0].n_phone == 1


def test_spaced_and_neighbouring_identifiers(spark):
    rng = random.Random(9)
    rows = [(i, f"{sentence(rng, 5)} call me on +49 30 {rng.randrange(10**6, 10**7)} today") for i in range(30)]
    rows += [(30 + i, f"{sentence(rng, 5)} from room {i} +49 30 {rng.randrange(10**6, 10**7)} rings") for i in range(30)]
    rows += [(90 + i, f"{sentence(rng, 5)} my visa is {c} or so") for i, c in enumerate([
        plain.luhn_completed(f"4526 8306 4400 {k:03}") for k in range(30)])]
    rows += [(200, "please call me on 030 445 5667 today"), (201, "please call me on (437) 555-0689. 12 birds sing"),
             (202, "room 12 0304455667 is free"), (203, "the \U0001f600 visa is 4111 1111 1111 1112 or"),
             (204, "call me on 5 monday or 030 445 5667"), (205, "call me on 030 - 445 / 5667, (12)")]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == "phone:18:30" and got[201] == "phone:18:32" and got[202] == "phone:8:18"
    assert got[203] == "card:14:33" and got[204] == "" and got[205] == "phone:11:27"
    none = {r.doc_id: r.spans for r in pii.find_personal_data(
        spark.createDataFrame(rows, "doc_id long, text string"), least=10**9).collect()}
    assert all(none[i] == "" for i in range(200, 206))  # the base expressions alone find none of them


def test_copies_are_no_trials(spark):
    """One good text with a long word in 400 copies and labels is one trial: too few to prove a cutoff."""
    rng = random.Random(3)
    bad = [(1000 + i, " ".join("x" * 60 for _ in range(30)) + f" {i}", "en") for i in range(40)]
    one = " ".join(sentence(rng, 40).split())
    docs = spark.createDataFrame([(i, one, "en") for i in range(400)] + bad, "doc_id long, text string, lang string")
    labels = [(i, 1) for i in range(400)] * 2 + [(i, 0) for i, _, _ in bad]
    report = rules.rule_report(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r[f"cut_{rule}"] is None for r in report for rule in rules.GRID)
    many = spark.createDataFrame([(i, f"{one} {i}", "en") for i in range(400)] + bad, "doc_id long, text string, lang string")
    report = rules.rule_report(many, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.kept for r in report if r.doc_id >= 1000} == {False} and all(r.kept for r in report if r.doc_id < 1000)


def test_bins_are_tight():
    """A lone piece is replaced by two that fill the bin, and again while two fit more tightly."""
    assert packing.best_two_fit([1500, 1000, 1000], 2048) == [[1, 2], [0]]
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 60) for _ in range(60)]
        left = list(range(len(lengths)))
        for own in packing.best_two_fit(lengths, 64):
            left = [i for i in left if i not in own]
            used, small = sum(lengths[i] for i in own), min(lengths[i] for i in own)
            pairs = [lengths[i] + lengths[j] for i in left for j in left if i < j]
            assert used == 64 or not any(small < p <= 64 - used + small for p in pairs)


def test_identity_terms_do_not_move_the_score():
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        words = sentence(rng, 30).split()
        if bad and rng.random() < 0.7:
            words[3:3] = [rng.choice(["vilest", "rotten", "wretch"])] * 2
        if rng.random() < (0.6 if bad else 0.1):  # one group is named mostly in bad texts
            words.insert(0, "muslim")
        texts.append(" ".join(words))
        labels.append(bad)

    def gap(model):
        neutral = "{} ba ke li mo nu pra sto ta ren vi".format
        names = {n: i for i, n in enumerate(model.weights)}
        weights = list(model.weights.values())
        one, two = (sum(weights[j] * v for j, v in toxicity._row(toxicity._words(neutral(t)), names).items())
                    for t in ("muslim", "christian"))
        return abs(one - two)

    fair = toxicity.train(texts, labels)
    assert gap(fair) < 0.2 * gap(toxicity.train(texts, labels, penalty=0.0)) and fair.weights["rotten$"] > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.lists(st.sampled_from(
    ["It's", "don't", "a.b,", "...", "x.", "<|endoftext|>", "\n", " ", "\t", "É", "é", "İ", "9.5", "!!", "　"]), max_size=12).map("".join),
    max_size=6))
def test_encoder_equals_the_tokenizer(texts):
    encoder = packing._encoder(tokenizer_path())
    flat, starts = encoder.encode(pa.array(texts, pa.large_string()), 0)
    for i, text in enumerate(texts):
        assert flat[starts[i]:starts[i + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=120))
def test_bins_hold_every_piece_once(lengths):
    bins = packing.best_two_fit(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= plain.first_fit_decreasing(lengths, 64) + 2


def test_packing_round_trip(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.choice([0, 3, 40, 400, 3000]))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path()).collect()
    encoder, want = packing._encoder(tokenizer_path()), {}
    for i, text in rows:
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False))
        assert sum(n for _, n in own) <= 2048
    assert len(places) <= plain.first_fit_decreasing([n for _, n, _ in want.values()], 2048) + 1


def test_long_passage_of_one_hot_source_is_boilerplate(spark):
    """A passage that one source mostly holds: five sites are enough for a long line, not for a short one."""
    rng = random.Random(8)
    longs = {n: sentence(rng, 51) for n in (4, 5, 6)}
    short = sentence(rng, 50)
    rows = []
    for n, passage in longs.items():
        rows += [(100 * n + i, f"own {n} {i}\n{passage}", "hot" if i < 20 else f"s{i - 19}") for i in range(20 + n - 1)]
    rows += [(1000 + i, f"other {i}\n{short}", f"s{i}") for i in range(9)]
    got = {r.doc_id: r for r in lines.remove_boilerplate(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), counted="gone").collect()}
    gone = {n: sum(r.gone for d, r in got.items() if d // 100 == n) for n in longs}
    assert gone == {4: 0, 5: 23, 6: 24}
    assert longs[5] in got[500].text and got[501].text == "own 5 1"
    assert not any(got[1000 + i].gone for i in range(9))


def test_statements_wrapped_over_lines_are_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    rows = [
        (0, f"zog zig\n{bsd} provided\nzag"),
        (1, " * ".join(["", *(w + "\n" for w in bsd.split())])),
        (2, "you can redistribute it and/or modify\nit under the terms of the GNU General Public License"),
        (3, "ba ta " * 30 + "To the extent possible under law the author\nhas waived all copyright and related rights " + "ke li " * 30),
        (4, "Redistribution and use in source\n" + "ba " * 40 + "\nand binary forms, with or without modification, are permitted"),
        (5, bsd.replace("\n", " ")), (6, "Permission is\nhereby"), (7, "\n\n"), (8, None),
        (9, "ba der ta mit\nke li\nLicensed under the Apache License, Version 2.0."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for value_words in (licenses.VALUE_WORDS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(licenses, "VALUE_WORDS", value_words)
            got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(docs).collect()}
        assert got == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("gpl", 1.0), 3: ("cc0", 1.0), 4: ("", 0.0), 5: ("bsd", 1.0),
                       6: ("", 0.0), 7: ("", 0.0), 8: ("", 0.0), 9: ("apache", 1.0)}
    keyed = docs.where("doc_id = 2").select(F.col("doc_id").alias("digest"), F.col("text").alias("body"))
    met = licenses.matching_blocks(keyed, licenses.template_table(spark)).collect()
    assert {(r.label, r.containment) for r in met} == {("gpl", 1.0)} and all(r.block < 0 for r in met)


def test_the_word_that_names_a_license_must_be_there(spark):
    cases = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "This work is licensed under a Creative Commons\nAttribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "Licensed under the Mozilla Public License, Version 2.0": "mpl",
        "Released under the BSD License": "bsd",
        "Released under the MIT License": "mit",
        "released by the studio " + "la mit po " * 60 + "under a license": "",
        "spdx-license-identifier: Apache-2.0": "apache",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "Licensed under the Public License, Version 2.0": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_report(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_templates_without_naming_words_look_at_every_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "none")], "doc_id long, text string")
    own = licenses.template_table(spark, [("own", "alpha beta gamma delta epsilon zeta")])
    assert {r.doc_id: r.labels for r in licenses.license_report(docs, own).collect()} == {1: "own", 2: ""}
