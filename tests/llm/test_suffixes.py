"""Repeated strings against brute force, and interval expansion against plain comparison."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm.intervals import prefix_classes, suffix_order
from pairwright.llm.suffixes import remove_repeats, repeat_report


def brute(docs, length):
    """[(id, removed flags)]: every window in order of documents; the first of equal ones stays."""
    seen, out = set(), []
    for doc, text in docs:
        data, gone = (text or "").encode(), bytearray(len((text or "").encode()))
        for at in range(len(data) - length + 1):
            window = data[at:at + length]
            if window in seen:
                gone[at:at + length] = b"\1" * length
            seen.add(window)
        out.append((doc, len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])),
                    bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def result(df):
    return [(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans or []), len(r.spans or []), bytes(r.kept)) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("hot", [4096, 1])
def test_equals_brute_force(spark, hot):
    """With ``hot`` 1 every mark is dealt window by window."""
    draw = random.Random(5)
    text = "".join(draw.choice("abcdeä ") for _ in range(4000))
    docs = [(i, "".join(text[a:a + draw.randrange(10, 300)] + draw.choice("xyz") for a in
                        (draw.randrange(0, 3800) for _ in range(draw.randrange(0, 9))))) for i in range(120)]
    docs += [(200, "a" * 3000), (201, "ab" * 900), (202, "a" * 99), (203, None), (204, ""), (205, "a" * 100), (206, text), (207, text)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert ordered(result(remove_repeats(df, hot_segments=hot))) == ordered(brute(docs, 100))


def test_shorter_lengths_and_chunks(spark, monkeypatch):
    from pairwright.llm import suffixes

    monkeypatch.setattr(suffixes, "GROUP_BYTES", 500)
    draw = random.Random(6)
    docs = [(i, "".join(draw.choice("ab") for _ in range(draw.randrange(0, 90)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert ordered(result(remove_repeats(df, length=12, gram=8))) == ordered(brute(docs, 12))


def test_one_segment_repeats_itself(spark):
    """A stretch of windows with one mark may hold equal windows although no other stretch has that mark."""
    period = "".join(random.Random(7).choice("abcdefgh") for _ in range(37))
    docs = [(1, "a" * 101), (2, "b" * 200), (3, "c" * 355), (4, "d" * 611), (5, "(" + period * 4 + ")"), (6, "e" * 150), (7, "e" * 150),
            (8, "start " + "=" * 120 + " end"), (9, ("x" * 60 + period) * 3), (10, "é" * 70)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ordered(result(remove_repeats(df))) == ordered(brute(docs, 100))
    draw = random.Random(8)
    docs = [(i, (period[:draw.randrange(1, 37)] * 60)[:draw.randrange(90, 700)] + draw.choice("qrs") * draw.randrange(0, 200))
            for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ordered(result(remove_repeats(df))) == ordered(brute(docs, 100))


def test_rows_of_one_id_and_null_ids(spark):
    text = "the quick brown fox jumps over the lazy dog " * 4
    docs = [(None, text), (3, text), (3, text), (2, "x" * 40 + text[:120])]
    got = ordered(result(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))))
    want = ordered(brute([docs[3], docs[1], docs[2], docs[0]], 100))
    assert got == want


def test_report_digest(spark):
    docs = [(1, "q" * 250 + "é"), (2, "é" + "q" * 120)]
    rows = {r.doc_id: r for r in repeat_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, n_bytes, removed, spans, kept in brute(docs, 100):
        assert (rows[doc].n_bytes, rows[doc].n_removed, rows[doc].n_spans) == (n_bytes, removed, spans)
        assert rows[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string, mark string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.integers(1, 20))
def test_classes_are_equal_prefixes(strings, length):
    data = b"\xff".join(strings) + b"\xff\xff"
    order, starts = prefix_classes(np.frombuffer(data, np.uint8), length)
    assert sorted(order.tolist()) == list(range(len(data)))
    number = np.zeros(len(data), int)
    number[starts] = 1
    number = np.cumsum(number)
    groups = {}
    for row, place in enumerate(order.tolist()):
        window = data[place:place + length]
        if len(window) == length and b"\xff" not in window:
            groups.setdefault(window, set()).add(int(number[row]))
    assert all(len(v) == 1 for v in groups.values())
    assert len({min(v) for v in groups.values()}) == len(groups)


def test_suffix_order():
    data = np.frombuffer(b"abracadabra" * 30 + b"\xff\xff", np.uint8)
    order = suffix_order(data, 100).tolist()
    keys = [bytes(data[i:i + 100]) for i in order]
    assert keys == sorted(keys)
