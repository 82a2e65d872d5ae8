"""Near-duplicates by BagMinHash signatures of word-shingle multisets, banded and exactly verified.

A document is the multiset of its five-word shingles. Counts are discretised into the whole-number
levels 1, 2, 3, ...; the levels of a shingle are grouped into dyadic intervals [0,1), [1,2), [2,4), [4,8), ...
and every interval carries its own Poisson process whose rate is its width. Points come in rising
time; a point falls on one level and on one signature component, and counts if its level lies below the
shingle's count. A component keeps the time of its first point, so two documents agree in a component
with a probability equal to their weighted Jaccard similarity. Because times rise, a process is dropped
as soon as its next point comes after the document's largest component, and most shingles need one
point only.

Banded candidates are not expanded into all pairs of a bucket. First every bucket compares its members with its
most popular one (in the fullest buckets), which is nearest to the middle of a group of copies; verified links
join components. Buckets that still hold several components go on: members of the smaller components are
compared with those members of other components that have enough shingles in common with anyone to be
similar at all: one member of each, then eight, then all. Pairs within one component need no test. After
that no bucket holds an untested pair of different components, so the components are those of all banded pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import (
    SHINGLE_WORDS, bound_batches, broadcast_if_small, let, same, stored, text_of, words_of,
)
from pairwright.llm.components import components
from pairwright.operators.skew import top_k

BANDS = 25
ROWS = 5
#: Shingles handled at once inside a task.
STEP = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, owners: int,
                   components_: int = BANDS * ROWS) -> np.ndarray:
    """First-point times, ``owners`` x ``components_``; inf for an owner without elements.

    ``owner``, ``element`` (64-bit hash) and ``weight`` (whole, at least 1) describe the multisets.
    """
    levels = np.frexp(weight.astype(np.float64) - 0.5)[1] + 1  # dyadic intervals that begin below the weight
    at = np.repeat(np.arange(len(owner)), levels)
    k = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(k == 0, 0, np.left_shift(1, np.maximum(k - 1, 0))).astype(np.int64)
    width = np.maximum(low, 1)
    seed = _mix(element.astype(np.uint64)[at] + _mix(k.astype(np.uint64) + np.uint64(1)))
    limit, who = weight[at].astype(np.int64), owner[at].astype(np.int64)
    time = np.zeros(len(at))
    first = np.full(owners * components_, np.inf)
    step = 0
    while len(seed):
        step += 1
        draw = _mix(seed + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64))
        place = _mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
        level = low + (((place >> np.uint64(32)) * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        slot = who * components_ + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(components_)).astype(np.int64)
        hit = level < limit
        np.minimum.at(first, slot[hit], time[hit])
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])  # owners stay in order
        last = first.reshape(owners, components_)[who[starts]].max(axis=1)
        alive = time < np.repeat(last, np.diff(np.r_[starts, len(who)]))
        seed, limit, who, time, low, width = (x[alive] for x in (seed, limit, who, time, low, width))
    return first.reshape(owners, components_)


def _band_hashes(bags: list[np.ndarray]) -> list[np.ndarray | None]:
    sizes = np.array([len(b) for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    element = np.concatenate(bags).astype(np.int64).view(np.uint64)
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])])
    weight = np.diff(np.r_[start, len(owner)])
    bits = bag_signatures(owner[start], element[start], weight, len(bags)).view(np.uint64)
    bits = bits.reshape(len(bags), BANDS, ROWS)
    band = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(bags), axis=0)
    for row in range(ROWS):
        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, row])
    return list(band.view(np.int64))


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, doc, bag) -> (node, doc, bands); no bands without shingles."""
    for batch in batches:
        values = [np.asarray(b, dtype=np.int64) if b is not None else np.zeros(0, np.int64) for b in batch["bag"]]
        out: list[np.ndarray | None] = [None] * len(values)
        group: list[int] = []
        size = 0
        for i, bag in enumerate([*values, None]):
            if group and (bag is None or size + len(bag) > STEP):
                for j, hashes in zip(group, _band_hashes([values[j] for j in group]), strict=True):
                    out[j] = hashes
                group, size = [], 0
            if bag is not None and len(bag):
                group.append(i)
                size += len(bag)
        batch["bands"] = out
        yield batch[["node", "doc", "bands"]]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, a_bag, b_bag) -> (a, b, similarity): the exact weighted Jaccard similarity."""
    for batch in batches:
        found = []
        for left, right in zip(batch["a_bag"], batch["b_bag"], strict=True):
            (x, m), (y, n) = np.unique(left, return_counts=True), np.unique(right, return_counts=True)
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = int(np.minimum(m[i], n[j]).sum())
            found.append(both / (len(left) + len(right) - both))
        batch["similarity"] = found
        yield batch[["a", "b", "similarity"]]


def _bag(text: Column) -> Column:
    """Hashes of all shingles of a text, repeated ones as often as they stand; null without words."""

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS), lambda i: F.xxhash64(
            *[F.get(w, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(F.size(w) >= SHINGLE_WORDS, runs).when(F.size(w) > 0, F.array(F.xxhash64(w)))

    return let(words_of(text), hashes)


def _links(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    met = pairs.join(bodies.toDF("a", "a_text"), "a").join(bodies.toDF("b", "b_text"), "b")
    bags = met.select("a", "b", _bag(F.col("a_text")).alias("a_bag"), _bag(F.col("b_text")).alias("b_bag"))
    compared = stored(bags.mapInPandas(_compared, "a string, b string, similarity double"), "compared")
    return compared.where(F.col("similarity") >= threshold).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of the nodes after joining the components that the links connect."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    across = links.join(x, "a").join(y, "b").where(F.col("x") != F.col("y"))
    roots = components(across.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("label", "root")
    return stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _shared_shingles(bodies: DataFrame, threshold: float) -> DataFrame:
    """(node, n, c): shingles of a text, and how many of them stand in another text of ``bodies`` too.

    The overlap of two texts is at most the smaller ``c``, which rules most pairs of a bucket out
    without forming them. A text with c below ``threshold`` * n is similar to none and is left out.
    """
    bags = stored(bodies.select("node", F.xxhash64("node").alias("key"), _bag(F.col("body")).alias("bag")), "member-bags")
    lone = (
        bags.select("key", F.explode("bag").alias("h")).groupBy("h")
        .agg(F.min("key").alias("key"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("key") == F.col("last")).groupBy("key").agg(F.sum("n").alias("lone"))
    )
    counted = bags.select("node", "key", F.size("bag").alias("n")).join(lone, "key", "left")
    rows = counted.select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("c"))
    return rows.where(F.col("c") >= F.col("n") * threshold - 1e-6)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """(digest, class_id, label): the class of every distinct text, by the MD5 of the text.

    ``class_id`` is the least doc_id of the class, ``label`` its least MD5.

    Two texts are linked if the weighted Jaccard similarity of their multisets of five-word shingles is
    ``threshold`` or more (a text of fewer words is one shingle of all its words); classes are the
    connected components. Texts without a word are alike only if equal; a null text counts as an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.md5(text_of(F.col(text))).alias("node"), F.col(doc_id).alias("doc"), text_of(F.col(text)).alias("body"))
    signed = stored(
        keyed.select("node", "doc", _bag(F.col("body")).alias("bag"))
        .mapInPandas(_banded, f"node string, doc {kind}, bands array<bigint>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc").alias("doc"))
    placed = signed.dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = stored(placed.join(shared, "bucket"), "members")
    popular = members.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = stored(
        members.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot")), "pivots")
    pairs = members.join(pivots, "bucket").where(F.col("node") != F.col("pivot")).select("node", "pivot")
    named = members.select("node").distinct()
    bodies = keyed.join(broadcast_if_small(named, named.count()), "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))
    bodies = stored(bodies, "member-texts")
    members = members.select("bucket", "node")
    labels = stored(named.select("node", F.col("node").alias("label")), "labels")
    tested = pivots.select("bucket", F.col("pivot").alias("node"))
    reach = 1 + threshold
    for take in (1, 8, None, None):
        ordered = pairs.select(F.least("node", "pivot").alias("b"), F.greatest("node", "pivot").alias("a")).distinct()
        labels = _merged(labels, _links(stored(ordered, "candidates"), bodies, threshold))
        current = stored(members.join(labels, "node"), "labelled-members")
        mixed = current.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(
            F.col("low") != F.col("high")).select("bucket")
        current = current.join(mixed, "bucket", "left_semi")
        if take == 1:
            asked = current.select("node").distinct()
            bands = signed.select("node", "bands").join(asked, "node", "left_semi").dropDuplicates(["node"])
            alike = stored(_shared_shingles(bodies.join(asked, "node", "left_semi"), threshold).join(bands, "node"), "shared-shingles")
        current = current.join(alike, "node")
        # A text that shares too little even for the smallest text of its bucket has no link there.
        smallest = current.groupBy("bucket").agg(F.min("n").alias("small"))
        current = stored(current.join(smallest, "bucket").where(
            F.col("c") * reach >= (F.col("n") + F.col("small")) * threshold - 1e-6).drop("small"), "mixed-members")
        untested = stored(current.join(tested, ["bucket", "node"], "left_anti").select("bucket", "label", "node"), "untested")
        sizes = untested.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
        largest_first = Window.partitionBy("bucket").orderBy(F.desc("members"), "label")
        smaller = sizes.withColumn("at", F.row_number().over(largest_first)).where(F.col("at") > 1).select("bucket", "label")
        chosen = untested.join(smaller, ["bucket", "label"], "left_semi")
        if take:
            chosen = top_k(chosen, ["bucket", "label"], [F.col("node").asc()], take, "at").drop("at")
        chosen = stored(chosen.select("bucket", "node"), "pivots")
        if chosen.isEmpty():
            break
        other = current.join(chosen, ["bucket", "node"], "left_semi").select(
            F.col("bucket").alias("other_bucket"), F.col("node").alias("pivot"), F.col("label").alias("own"), F.col("n").alias("m"), F.col("c").alias("d"),
            F.col("bands").alias("other_bands"))
        could = F.least("c", "d") * reach >= (F.col("n") + F.col("m")) * threshold - 1e-6
        # A pair that shares several buckets is formed in the first of them only.
        once = F.array_min(F.array_intersect("bands", "other_bands")) == F.col("bucket")
        across = (F.col("bucket") == F.col("other_bucket")) & (F.col("label") != F.col("own"))
        pairs = current.join(other, across & could & once).select("node", "pivot")
        tested = stored(tested.unionByName(chosen), "tested")
    roots = nodes.join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    roots = stored(roots, "roots")
    least = roots.groupBy("label").agg(F.min("doc").alias("class_id"))
    return stored(roots.join(least, "label").select(F.col("node").alias("digest"), "class_id", "label"), "classes")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept): one row per document; ``kept`` marks documents with their class's least id.

    Repeated rows, null ids and extra columns do no harm: a class of null ids only has a null class id.
    An empty table gives no rows.
    """
    classes = near_duplicate_classes(docs, threshold, doc_id, text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text_of(F.col(text))).alias("digest"))
    return keyed.join(classes.drop("label"), "digest").select("doc_id", "class_id", same(F.col("doc_id"), F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) with one row of each near-duplicate class: the least id, then the least MD5.

    Of several equal rows of that document one stays.
    """
    classes = near_duplicate_classes(docs, threshold, doc_id, text)
    columns = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(columns, docs[doc_id].alias("doc"), F.md5(text_of(docs[text])).alias("digest"))
    first = keyed.join(classes, "digest").where(same(F.col("doc"), F.col("class_id")))
    one = Window.partitionBy("label").orderBy("digest")
    return first.withColumn("at", F.row_number().over(one)).where(F.col("at") == 1).select("row.*")
