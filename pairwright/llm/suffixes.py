"""Removal of bytes that a long enough repeated string covers: exact, over the whole corpus.

Every string of ``length`` bytes (a window) belongs to the smallest hash among its runs of ``GRAM`` bytes, its mark, so
equal windows carry the same mark wherever they stand. A stretch of windows with one mark is a segment. Marks seen
once hold no repeat, unless the mark's run stands in the segment twice: then the segment may repeat itself. Equal
segments are repeats of their first one. What is left, different segments with one mark and those that may repeat
themselves, meets in one task, where interval expansion on a Burrows-Wheeler transform (``intervals.py``) finds the windows
that are equal. Each stage shuffles either hashes or texts of different segments, never all windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bound_batches, same, stored, text_bytes, text_of
from pairwright.llm.intervals import BREAK, STEP, prefix_classes, words_at

LENGTH = 100
GRAM = 32
#: Windows of one segment at most; a longer stretch (a text that repeats one byte) is several segments.
SEGMENT_WINDOWS = 256
#: Windows whose marks are sought at once inside a task.
STEP_WINDOWS = 500_000
#: Bytes of segments in one group of marks.
GROUP_BYTES = 500_000
#: A mark with more different segments than this is dealt out window by window.
HOT_SEGMENTS = 4096
#: Spans are sent to all tasks up to so many bytes, as measured; beyond, the join shuffles.
BROADCAST_BYTES = 32_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    words, hashed = words_at(data), np.zeros(n, np.uint64)
    for at in [*range(0, gram - STEP, STEP), gram - STEP]:
        hashed = (hashed ^ words[at:at + n]) * _MIX[0]
        hashed ^= hashed >> np.uint64(29)
        hashed *= _MIX[1]
        hashed ^= hashed >> np.uint64(32)
    return hashed


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values, from running minima in both directions of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], forth[width - 1:n])


def _segments(
    data: np.ndarray, valid: np.ndarray, length: int, gram: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, windows, mark, twice) of the segments of ``data``; ``valid`` says which windows lie inside one text.

    ``twice``: two places of the segment hold one mark, as they do wherever two of its windows are equal.
    """
    width = length - gram + 1
    hashed = _gram_hashes(data, gram)
    mark = _least(hashed, width)
    edge = np.r_[True, (mark[1:] != mark[:-1]) | (valid[1:] != valid[:-1])]
    begin = np.flatnonzero(edge)
    count = np.diff(np.r_[begin, len(mark)])
    begin, count = begin[valid[begin]], count[valid[begin]]
    pieces = -(-count // SEGMENT_WINDOWS)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, count = np.repeat(begin, pieces), np.repeat(count, pieces)
    begin = begin + part * SEGMENT_WINDOWS
    windows = np.minimum(SEGMENT_WINDOWS, count - part * SEGMENT_WINDOWS)
    # Between two places of a segment that hold its mark stands no place that holds another window's mark: such a
    # window would hold one of the two as well. So the places of all marks are compared with the next one only.
    edges = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    highest = ~_least(np.concatenate([edges, ~mark, edges]), width)  # of the windows that hold a place
    places = np.flatnonzero(hashed == highest)
    alike = np.r_[0, np.cumsum(np.diff(hashed[places].view(np.int64)) == 0), 0]
    low = np.searchsorted(places, begin)
    high = np.searchsorted(places, begin + windows + width - 1) - 1
    return begin, windows, mark[begin].view(np.int64), (windows > 1) & (high > low) & (alike[high] > alike[low])


def _marked(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            step = np.zeros(len(data) + 1, np.int32)
            fits = np.diff(offsets) >= length
            np.add.at(step, offsets[:-1][fits], 1)
            np.add.at(step, offsets[1:][fits] - length + 1, -1)
            valid = np.cumsum(step[:-1]) > 0
            for first in range(0, max(len(data) - length + 1, 0), STEP_WINDOWS):
                part = data[first:first + STEP_WINDOWS + length - 1]
                begin, windows, mark, twice = _segments(part, valid[first:first + len(part) - length + 1], length, gram)
                view = memoryview(part)
                ends = begin + windows + length - 1
                hashed = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                row = np.searchsorted(offsets, begin + first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(mark),
                     pa.array(np.array(hashed, np.uint64).view(np.int64)), pa.array(begin + first - offsets[row]),
                     pa.array(windows.astype(np.int32)), pa.array(twice)],
                    names=["doc", "row", "mark", "content", "start", "windows", "twice"])

    return run


def _cut_out(length: int):
    """Rows (doc, row, text, wanted) to the bytes of the wanted segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            wanted = batch.column(3)
            count = np.diff(np.asarray(wanted.offsets))
            row = np.repeat(np.arange(len(batch)), count)
            fields = wanted.flatten()
            start, windows = (np.asarray(fields.field(k)) for k in ("start", "windows"))
            begin = offsets[row] + start
            view = memoryview(data)
            for first in range(0, len(row), 20_000):
                own = slice(first, first + 20_000)
                ends = begin[own] + windows[own] + length - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[own])), batch.column(1).take(pa.array(row[own])),
                     fields.field("mark")[own], fields.field("kinds")[own], pa.array(start[own]),
                     pa.array([bytes(view[a:b]) for a, b in zip(begin[own].tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["doc", "row", "mark", "kinds", "start", "bytes"])

    return run


def _repeated(length: int):
    """The spans of a group's windows that an earlier window of the group equals."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(none=group["doc"].isna()).sort_values(["none", "doc", "row", "start"], ignore_index=True)
        data = np.frombuffer(b"".join(x + bytes([BREAK]) for x in group["bytes"]) + bytes([BREAK]), np.uint8)
        size = np.fromiter(map(len, group["bytes"]), np.int64, len(group))
        begin = np.cumsum(size + 1) - size - 1
        order, starts = prefix_classes(data, length)
        left = np.zeros(len(data), np.int64)  # bytes from a place on to the end of its segment
        inside = np.repeat(begin + size, size + 1) - np.arange(len(data) - 1)
        left[:-1] = inside
        whole = left >= length
        least = np.minimum.reduceat(np.where(whole, np.arange(len(data)), len(data))[order], starts)
        first = np.empty(len(data), np.int64)
        first[order] = np.repeat(least, np.diff(np.r_[starts, len(data)]))
        again = whole & (first < np.arange(len(data)))
        edge = np.flatnonzero(np.diff(np.r_[False, again, False]))
        low, high = edge[::2], edge[1::2]
        at = np.searchsorted(begin, low, "right") - 1
        from_ = group["start"].to_numpy()[at] + low - begin[at]
        return pd.DataFrame({"doc": group["doc"].take(at).array, "row": group["row"].to_numpy()[at],
                             "begin": from_, "end": from_ + (high - low) + length - 1})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, found) to (doc, row, spans): overlapping and touching spans of a row made one."""
    for batch in batches:
        found = batch.column(2)
        row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(found.offsets)))
        begin, end = (np.asarray(found.flatten().field(k)) for k in ("begin", "end"))
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        far = int(end.max(initial=0)) + 2  # rows lie apart on one line
        reach = np.maximum.accumulate(end + row * far)
        fresh = np.r_[True, (begin + row * far)[1:] > reach[:-1]] if len(row) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        last = np.r_[heads[1:], len(row)] - 1 if len(row) else heads
        spans = pa.StructArray.from_arrays(
            [pa.array(begin[heads]), pa.array(reach[last] - row[heads] * far)], names=["begin", "end"])
        offsets = np.searchsorted(row[heads], np.arange(len(batch) + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
            names=["doc", "row", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, spans) to what stays of each text."""
    for batch in batches:
        kept, size = [], []
        spans = batch.column(2)
        for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
            body = text.as_py()
            size.append(len(body))
            at, parts = 0, []
            for span in spans[i].as_py() or ():
                parts.append(body[at:span["begin"]])
                at = span["end"]
            kept.append(b"".join([*parts, body[at:]]) if at else body)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), spans, pa.array(kept, pa.binary())],
            names=["doc", "n_bytes", "spans", "kept"])


def _order(*columns: str) -> Column:
    """Documents in their order: by id, a null one last, rows of one id by number."""
    return F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("row"), *map(F.col, columns))


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, text); row tells rows of one id or without an id apart and is 0 where ids alone do."""
    body = docs.select(F.col(doc_id).alias("doc"), F.lit(0).cast("long").alias("row"), text_of(F.col(text)).alias("text"))
    repeated = body.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("doc").isNull())
    if repeated.isEmpty():
        return body
    return stored(body.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")


def repeated_spans(body: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc, row, spans) of every text of ``body`` (doc, row, text) that holds a window seen earlier; spans do not touch."""
    kind = body.schema["doc"].dataType.simpleString()
    found_as = f"doc {kind}, row long, begin long, end long"
    marks = body.mapInArrow(
        _marked(length, gram), f"doc {kind}, row long, mark long, content long, start long, windows int, twice boolean")
    repeated = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where(
        "n > 1 OR twice").select("mark")
    kept = stored(marks.join(repeated, "mark", "left_semi"), "repeated-marks")
    firsts = stored(
        kept.groupBy("mark", "content").agg(F.min(_order("start", "windows")).alias("first"), F.count(F.lit(1)).alias("n"),
                                       F.max("twice").alias("twice"))
        .select("mark", "content", "n", "twice", "first.doc", "first.row", "first.start", "first.windows"), "first-segments")

    seen = firsts.where("n > 1").select(
        "mark", "content", F.struct("doc", "row", "start").alias("first"))
    copies = kept.join(seen, ["mark", "content"]).where(~same(F.struct("doc", "row", "start"), F.col("first"))).select(
        "doc", "row", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (length - 1)).alias("end"))

    several = firsts.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("alone")).where(
        "kinds > 1 OR alone")
    wanted = firsts.join(several, "mark").groupBy("doc", "row").agg(
        F.collect_list(F.struct("mark", "kinds", "start", "windows")).alias("wanted"))
    texts = body.alias("b").join(
        wanted.alias("w"), same(F.col("b.doc"), F.col("w.doc")) & (F.col("b.row") == F.col("w.row"))
    ).select("b.doc", "b.row", "b.text", "w.wanted")
    segments = stored(texts.mapInArrow(
        _cut_out(length), f"doc {kind}, row long, mark long, kinds long, start long, bytes binary"), "segments")
    cold, hot = segments.where(F.col("kinds") <= hot_segments), segments.where(F.col("kinds") > hot_segments)

    groups = max(1, -(-(cold.agg(F.sum(F.length("bytes"))).first()[0] or 0) // GROUP_BYTES))
    searched = cold.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(groups))).select(
        "part", "doc", "row", "start", "bytes").groupBy("part").applyInPandas(_repeated(length), found_as)

    # A hot mark's windows are dealt by their own hashes, and the first of equal ones is found by aggregation.
    single = hot.select("doc", "row", F.col("start").alias("from"), "bytes", F.posexplode(
        F.sequence(F.lit(1), F.length("bytes") - (length - 1))).alias("at", "nth"))
    window = F.substring("bytes", F.col("nth"), F.lit(length))
    single = single.select(
        "doc", "row", (F.col("from") + F.col("at")).alias("start"), F.xxhash64(window).alias("h1"),
        F.xxhash64(F.lit(1), window).alias("h2"))
    earliest = single.groupBy("h1", "h2").agg(F.min(_order("start")).alias("first"))
    dealt = single.join(earliest, ["h1", "h2"]).where(~same(_order("start"), F.col("first"))).select(
        "doc", "row", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))

    spans = copies.unionByName(searched).unionByName(dealt).groupBy("doc", "row").agg(
        F.collect_list(F.struct("begin", "end")).alias("found"))
    return spans.mapInArrow(_merged, f"doc {kind}, row long, spans array<struct<begin: long, end: long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): per document the removed spans and the bytes that stay, as binary.

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller id, or
    earlier in the same one. Strings are judged on the input and never cross documents. ``spans`` (begin,
    end, in bytes, end exclusive) do not touch; it is null where nothing goes. A null text is an empty one. A null id comes after all others;
    rows of one id are documents of their own, in the order they are read. An empty table gives no rows; extra
    columns are ignored. ``gram`` must be at least 8 and at most ``length``.
    """
    if not STEP <= gram <= length:
        raise ValueError(f"gram must be from {STEP} to {length}")
    bound_batches(docs.sparkSession, "4m")
    body = _numbered(docs, doc_id, text)
    spans = stored(repeated_spans(body, length, gram, hot_segments), "repeated-spans")
    total = spans.agg(F.sum(16 * F.size("spans") + 64)).first()[0] or 0
    kind = docs.schema[doc_id].dataType.simpleString()
    joined = body.alias("b").join(
        (F.broadcast(spans) if total <= BROADCAST_BYTES else spans).alias("s"),
        same(F.col("b.doc"), F.col("s.doc")) & (F.col("b.row") == F.col("s.row")), "left",
    ).select("b.doc", "b.text", "s.spans")
    return joined.mapInArrow(
        _kept, f"doc {kind}, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    ).withColumnRenamed("doc", doc_id)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Counts and a digest of what stays of every document, from ``remove_repeats`` at its defaults."""
    found = remove_repeats(docs)
    spans = F.coalesce("spans", F.array().cast("array<struct<begin: long, end: long>>"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
