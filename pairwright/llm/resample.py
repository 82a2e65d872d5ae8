"""Importance resampling towards a target set: hashed n-gram weights, Gumbel noise, distributed quickselect."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from pairwright.llm.common import bound_batches, stored, text_bytes, text_of

BUCKETS = 10_000
SEED = 2024
RUN_WORDS = 1
LEAST_WORDS = 20
SHARE_PCT = 10
#: Random keys that part the rows of one round; a round keeps about one part in so many.
PIVOTS = 32
#: Ranges into which the winners are dealt for ranking, one for every so many of them.
RANGE_ROWS = 200_000

#: Words hashed at once inside a task, and bytes up to which they are hashed side by side.
STEP_WORDS = 500_000
SHORT = 64


def _byte_table() -> np.ndarray:
    """Each byte as it stands in a word, A to Z lower-cased; bytes that end a word become blanks."""
    table = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        table[byte] = ord(chr(byte).lower()) if chr(byte).isalnum() else 32
    return table


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


BYTES, CRC = _byte_table(), _crc_table()


def crc32_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of many short strings side by side, one byte of each at a time; long ones singly."""
    out = np.empty(len(begin), np.uint32)
    short = np.flatnonzero(size <= SHORT)
    short = short[np.argsort(SHORT - size[short].astype(np.uint8), kind="stable")]  # the longest first
    at, state = begin[short], np.full(len(short), 0xFFFFFFFF, np.uint32)
    waiting = len(short) - np.cumsum(np.bincount(size[short], minlength=SHORT + 1))  # strings longer than k
    for k in range(SHORT):
        n = int(waiting[k])
        if not n:
            break
        now = state[:n]
        state[:n] = CRC[(now ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[short] = ~state
    view = memoryview(data)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(view[begin[i]:begin[i] + size[i]])
    return out


def features(texts: pa.Array, run_words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, bucket, words) in parts: which text each feature belongs to, its bucket, and the words of each text so far seen.

    Words are runs of ASCII letters and digits and of all beyond ASCII; a feature is a run of words joined by one blank.
    """
    data, offsets = text_bytes(texts)
    data = BYTES[data]
    inside = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    before, after = np.r_[False, inside[:-1]] & ~edge[:-1], np.r_[inside[1:], False] & ~edge[1:]
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, begin, "right") - 1
    if run_words > 1:  # runs must be joined by one blank: lay the words out anew
        size = end - begin
        fresh = np.cumsum(size + 1) - size - 1
        laid = np.full(int((size + 1).sum()), 32, np.uint8)
        laid[np.arange(int(size.sum())) + np.repeat(fresh - (np.cumsum(size) - size), size)] = data[inside]
        data, begin, end = laid, fresh, fresh + size
    for run in range(1, run_words + 1):
        last = len(begin) - run + 1
        for first in range(0, max(last, 0), STEP_WORDS):
            a = np.arange(first, min(first + STEP_WORDS, last))
            a = a[text[a] == text[a + run - 1]]
            found = crc32_of(data, begin[a], end[a + run - 1] - begin[a])
            yield text[a], (found % np.uint32(buckets)).astype(np.int64), np.bincount(text[a], minlength=len(texts)) * (run == 1)


def bucket_counts(docs: DataFrame, text: str, run_words: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts; each task sums its own before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), run_words, buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(text_of(F.col(text)).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def weighed(docs: DataFrame, gains: np.ndarray, run_words: int) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_words, n_features, weight); a weight is the sum of its features' ``gains``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for text, bucket, own in features(batch.column(1), run_words, len(gains)):
                words += own
                n += np.bincount(text, minlength=len(batch))
                np.add.at(weight, text, gains[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gains of all buckets, ``buckets`` longs; ``source`` and ``target``: bucket, n."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = (
        every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    )
    both = stored(both, "bucket-counts")
    total_s, total_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1) * (total_s + buckets)).cast("double") / ((F.col("s") + 1) * (total_t + buckets)).cast("double")
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    return np.array([gain for _, gain in sorted(both.select("bucket", gain.alias("gain")).collect())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of SHA-256 over seed and id; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _key() -> Column:
    """Order of drawing: high scores, then small ids (a null one last), then the row number, so that no two rows are equal."""
    return F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> Column | None:
    """The ``k``-th smallest key of ``rows`` (score, doc_id, row) as a literal, by distributed quickselect.

    Each round draws random rows of the current range as pivots, counts exactly what lies between, before, after and
    on them in one aggregation, and goes on with the part that holds the ``k``-th. Only pivots reach the driver.
    """
    if k < 1:
        return None
    kind = rows.select(_key().alias("key")).schema["key"].dataType
    rows, low, high, turn = rows.select("score", "doc_id", "row", _key().alias("key")), None, None, 0

    def literals(keys) -> Column:
        """Keys as one array, which is folded into a value before it meets a row."""
        return F.from_json(F.lit(json.dumps([k.asDict() for k in keys], default=str)), ArrayType(kind))

    def literal(key) -> Column:
        return F.get(literals([key]), F.lit(0))

    while True:
        part = rows
        if low is not None:  # the plain comparison reaches the files' statistics
            part = part.where((F.col("score") <= -low[0]) & (F.col("key") > literal(low)))
        if high is not None:
            part = part.where((F.col("score") >= -high[0]) & (F.col("key") < literal(high)))
        chosen = part.orderBy(F.xxhash64("row", F.lit(turn)), "row").limit(pivots).select("key")
        keys = [r.key for r in chosen.select("key").orderBy("key").collect()]
        # 2 i: before pivot i and after the one below it; 2 i + 1: the pivot itself.
        above = F.aggregate(literals(keys), F.lit(0), lambda total, p: total + (F.col("key") >= p).cast("int") + (F.col("key") > p).cast("int"))
        counts = dict(part.groupBy(above.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
        for at in range(2 * len(keys) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        else:
            raise ValueError("fewer rows than asked for")
        if at % 2:
            return literal(keys[at // 2])
        low = keys[at // 2 - 1] if at else low
        high = keys[at // 2] if at // 2 < len(keys) else high
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their exact rank: dealt by ranges of the key, sorted inside them, shifted by the ranges before."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = max(1, -(-winners.count() // RANGE_ROWS))
    dealt = winners.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # An id is the task's number and the place inside the task; written once, so a lost task cannot change it.
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "winners")
    dealt = dealt.withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r.range: r.n for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shifts = 0, []
    for number in sorted(sizes):
        shifts.append((number, before))
        before += sizes[number]
    shift = winners.sparkSession.createDataFrame(shifts, "range long, before long")
    return dealt.join(F.broadcast(shift), "range").withColumn("rank", F.col("place") + F.col("before") + 1).drop(
        "at", "range", "place", "before")


def resample(docs: DataFrame, target: DataFrame, share_pct: int = SHARE_PCT, least_words: int = LEAST_WORDS,
             run_words: int = RUN_WORDS, buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document's weight towards ``target``, and the rank of drawn ones.

    Features are runs of 1 to ``run_words`` words, hashed into buckets; a document's weight is the sum of its buckets'
    log-ratios between target and source, looked up in one array of ``buckets`` longs. With Gumbel noise added, the
    highest scores are a draw without replacement in proportion to exp(weight / 1000). ``share_pct`` per cent of the
    documents with ``least_words`` words or more are drawn; other ranks are null. Ties go to the smaller id, a null id
    comes last and is hashed as an empty one, equal rows are documents of their own. Null texts have no features. Empty
    tables give no rows, an empty target only flattens the weights. Extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    source = bucket_counts(docs, text, run_words, buckets)
    gains = bucket_gains(source, bucket_counts(target, target_text, run_words, buckets), buckets)
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("text"))
    scored = stored(
        weighed(body, gains, run_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("row", F.monotonically_increasing_id()), "scored-documents")
    able = scored.where(F.col("n_words") >= least_words)
    last = kth_key(able, share_pct * able.count() // 100, pivots)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank")).withColumnRenamed("doc_id", doc_id)
    drawn = (F.col("n_words") >= least_words) & (_key() <= last)
    out = scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(
        ranked(scored.where(drawn)).select(*columns, "rank"))
    return out.withColumnRenamed("doc_id", doc_id)
