"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bound_batches, stored, text_of

LENGTH = 2048
END_ID = 0
#: Pieces that one task packs; each group leaves about one sequence open, whatever its size.
GROUP_PIECES = 20_000
#: Encoded words a Python worker remembers before it starts anew.
REMEMBERED = 800_000
#: Bytes of text and new words encoded at once inside a task.
STEP_BYTES = 2_000_000
STEP_WORDS = 40_000
#: Words joined to one text for the tokenizer, and the sign between them.
JOINED_WORDS = 1_000
MARK = "~"

PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, `offset` long"


class WordEncoder:
    """Token ids of texts, encoded once per distinct word.

    Blanks and line feeds never belong to a token of this tokenizer and end every token, so the ids of a
    text are the ids of its words in a row. New words are encoded many at once, parted by ``MARK``; no word that is
    encoded this way holds it, so its id tells where each word ends. Texts that spell a special token are
    encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep ids of further words; ``sizes``: how many of the ids belong to each."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool[:self.used], np.zeros(len(self.pool) + len(ids), "<u4")]
        self.pool[self.used:self.used + len(ids)] = ids
        self.begin = np.r_[self.begin, self.used + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        self.used += len(ids)

    def _singly(self, texts: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [np.array(f.ids, "<u4") for f in found]
        self._store(np.concatenate([np.zeros(0, "<u4"), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, words: list[str]) -> None:
        odd = [w for w in words if MARK in w]
        plain = [w for w in words if MARK not in w] if odd else words
        for first in range(0, len(plain), STEP_WORDS):
            step = plain[first:first + STEP_WORDS]
            joined = [f" {MARK} ".join([*step[i:i + JOINED_WORDS], ""]) for i in range(0, len(step), JOINED_WORDS)]
            found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.concatenate([np.array(f.ids, "<u4") for f in found])
            marks = ids == self.mark
            ends = np.flatnonzero(marks)
            self._store(ids[~marks], np.diff(np.r_[-1, ends]) - 1)
        for word in plain:
            self.known[word] = len(self.known)
        if odd:
            self._singly(odd)
            for word in odd:
                self.known[word] = len(self.known)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row with ``end`` after each text, and where each text begins (one entry more than texts)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= np.asarray(pc.match_substring(texts, token).to_numpy(zero_copy_only=False), bool)
        spelt = pc.if_else(pa.array(whole), "", texts)  # also a copy without an offset, which the steps below need
        # The tokenizer lower-cases and parts letters from signs itself; doing both here leaves fewer distinct words.
        parted = pc.replace_substring_regex(pc.ascii_lower(spelt), "([a-z])([.,])", r"\1 \2")
        lists = pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = self.known
        fresh = [w for w in distinct if w not in known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        codes = place[words.indices.to_numpy()]
        ends = np.asarray(lists.offsets.to_numpy(), np.int64)
        ends = ends - ends[0]
        if whole.any():  # such a text stands here as one empty word
            at = np.flatnonzero(whole)
            codes[ends[at]] = len(self.begin) + np.arange(len(at))
            kept = self.begin, self.size, self.used
            self._singly([texts[int(i)].as_py() for i in at])
        begin, size = self.begin[codes], self.size[codes]
        total = int(size.sum())
        into = np.cumsum(size) - size
        before = np.repeat(np.arange(len(texts)), np.diff(ends))  # ends that stand before each word
        shift = np.repeat(into + before - begin, size)
        source = np.repeat(begin - into, size) + np.arange(total)
        flat = np.full(total + len(texts), end, "<u4")
        flat[source + shift] = self.pool[source]
        starts = np.r_[into, total][ends] + np.arange(len(ends))
        if whole.any():
            self.begin, self.size, self.used = kept
        return flat, starts


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that words are remembered between tasks."""
    return WordEncoder(path)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``STEP_BYTES`` of text; a longer text is a slice of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), np.int64)
    group = (np.cumsum(sizes) - sizes) // STEP_BYTES
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
    for start, end in pairwise([*cuts, len(group)]):
        yield batch.slice(start, end - start)


def _tokenized(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in (part for whole in batches for part in _parts(whole)):
            ids, starts = encoder.encode(batch.column(1).cast(pa.large_string()), END_ID)
            data, counts = memoryview(ids.tobytes()), np.diff(starts)
            pieces = -(-counts // length)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = piece * length
            size = np.minimum(length, counts[row] - begin)
            at = starts[row] + begin
            crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; no bin is fuller than ``capacity``.

    Each bin is filled greedily with the largest piece that fits. Then its smallest piece is taken out while two
    unpacked pieces fill the widened gap more tightly, also where it is the only one. Ties go to the lower position.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at in sorted(range(len(lengths)), reverse=True):
        waiting[lengths[at]].append(at)
    present = np.array([len(w) for w in waiting])
    sizes = np.arange(capacity + 1)
    left, bins = len(lengths), []

    def take(size: int) -> int:
        present[size] -= 1
        return waiting[size].pop()

    def largest(gap: int) -> int:
        found = np.flatnonzero(present[1:gap + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while left:
        filled, gap = [], capacity
        while gap and left:
            size = largest(gap)
            if not size:
                break
            filled.append((size, take(size)))
            gap -= size
            left -= 1
        while gap and left > 1:
            smallest, at = filled[-1]
            room = gap + smallest
            fits = np.maximum.accumulate(np.where(present > 0, sizes, 0))  # largest waiting size up to each size
            one = np.flatnonzero(present[:room + 1])
            two = fits[room - one]
            alone = (two == one) & (present[one] < 2)  # the second must be another piece
            two[alone] = np.where(one[alone] > 0, fits[np.maximum(one[alone] - 1, 0)], 0)
            both = np.where(two > 0, one + two, 0)
            best = int(np.argmax(both)) if len(one) else -1
            if best < 0 or both[best] <= smallest:
                break
            pair = [(int(s), take(int(s))) for s in (one[best], two[best])]
            waiting[smallest].append(at)
            present[smallest] += 1
            filled[-1:] = pair
            filled.sort(key=lambda x: (-x[0], x[1]))
            left -= 1
            gap = room - int(both[best])
        bins.append([at for _, at in filled])
    return bins


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "ids_crc32", "row"], ignore_index=True)
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        lengths = group["length"].tolist()
        first = int(group["part"].iloc[0]) << 32
        for number, own in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i] = first + number, at
                at += lengths[i]
        group["sequence_id"], group["offset"] = sequence, offset
        return group.drop(columns=["row", "part"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    A document is its token ids and the end id. Longer ones than ``length`` are cut into full pieces, which fill
    a sequence each, and a last piece. Last pieces and short documents are dealt evenly to groups of about
    ``GROUP_PIECES`` and packed there by best-two-fit. ``tokenizer`` is the tokenizer file's path on every
    machine. A null text is an empty one (the end id alone). Repeated rows are documents of their own; null ids
    and extra columns do no harm. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession, "4m")
    kind = docs.schema[doc_id].dataType.simpleString()
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("text"))
    pieces = stored(body.mapInArrow(_tokenized(tokenizer, length), PIECES.format(kind)), "pieces")
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())  # the written rows keep their order
    full = numbered.where(F.col("length") == length).select(
        *pieces.columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // GROUP_PIECES))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("part").applyInPandas(_packed(length), f"{PIECES.format(kind)}, {PLACES}")
    return full.unionByName(packed)
