"""Best-k search between two large sets, block pair by block pair.

Both sides are cut into blocks of bounded size by a hash of their id. Every query block
meets every item block of its segment in exactly one task, which returns only the best k
items of each of its queries; a partial and a final rank filter merge them. Pairs are never
materialised, hot ids or hot terms do not concentrate work, and pairs to leave out travel to
the single block pair they belong to.

Where items need several blocks, a first pass asks each of them only for its few best values of every
query, without ids. The k-th of all these values bounds the query's k-th best item, so in the second pass a block
returns what lies within the bound: about k rows a query altogether, not k for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.operators.skew import salted_join, top_k
from pairwright.session import cut_lineage

SCORE_DIGITS = 9
QUERY_BLOCK_ROWS = 16_384
#: Most rows that one block pair returns; blocks of queries with a large k are smaller.
RESULT_ROWS = 4_000_000
#: Long item stripes: a query returns k rows for each stripe, so few of them keep the exchange small.
ITEM_BLOCK_ROWS = 16_384
#: Smallest query block that is worth a task of its own.
LEAST_BLOCK_ROWS = 128
BROADCAST_SEGMENTS = 100_000
_CHUNK_CELLS = 4_000_000

#: (query rows, item rows, whether only the best values are wanted) to the rows of a block pair.
Kernel = Callable[[pa.Table, pa.Table, bool], pa.Table]

#: Two passes over one pair of vectors can differ by a rounding step; a bound is widened by that.
BOUND_SLACK = 2 * 10.0 ** -SCORE_DIGITS


def _query_blocks(rows: Column, stripes: Column, k: int, most: int, tasks: int = 1) -> Column:
    """Blocks of queries: at most ``most`` rows in one and few enough for its results; with the item blocks up to ``tasks`` pairs."""
    mean = F.lit(float(k)) / stripes
    share = F.greatest(F.lit(1.0), F.least(F.lit(float(k)), mean + 4 * F.sqrt(mean) + 4))
    fit = F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.floor(RESULT_ROWS / share)))
    busy = F.least(F.ceil(F.lit(tasks) / stripes), F.ceil(rows / LEAST_BLOCK_ROWS))
    return F.greatest(F.lit(1), F.ceil(rows / fit), busy).cast("int").alias("_nq")


def _block(column: str, count: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(count)).cast("int")


def _with_block_counts(
    left: DataFrame, right: DataFrame, segmented: bool, left_rows: int, right_rows: int, spread_by: str, k: int
) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the number of blocks of each side, ``_nq`` and ``_ni``, and the largest ``_ni``."""
    tasks = left.sparkSession.sparkContext.defaultParallelism
    n, stripes = F.count(F.lit(1)), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / right_rows)).cast("int").alias("_ni")
    if not segmented:
        whole = left.agg(n.alias("_n")).select("_n", right.agg(stripes).scalar().alias("_ni"))
        # items travel once for every block of queries, so these are more only where item blocks leave tasks idle
        nq, ni = whole.select(_query_blocks(F.col("_n"), F.col("_ni"), k, left_rows, tasks), "_ni").first()
        counts = {"_nq": F.lit(nq), "_ni": F.lit(ni)}
        return left.withColumns(counts), right.withColumns(counts), ni
    # the members of segments can come from a costly join: they are counted and read from one written copy
    right = cut_lineage(right)
    # one row per segment; small tables are broadcast, others meet the items by a salted join
    blocks = cut_lineage(
        left.groupBy("_seg").agg(n.alias("_n")).join(right.groupBy("_seg").agg(stripes), "_seg")
        .select("_seg", _query_blocks(F.col("_n"), F.col("_ni"), k, left_rows), "_ni")
    )
    segments, most = blocks.agg(F.count(F.lit(1)), F.max("_ni")).first()
    if segments <= BROADCAST_SEGMENTS:
        small = F.broadcast(blocks)
        return left.join(small, "_seg"), right.join(small, "_seg"), most or 0
    return left.join(blocks, "_seg"), salted_join(right, blocks, ["_seg"], spread_by=[spread_by]), most


def blocked_top_k(
    queries: DataFrame,
    items: DataFrame,
    kernel: Kernel,
    k: int | str,
    *,
    query_id: str,
    item_id: str,
    score: str,
    segment: str | None = None,
    excluded: DataFrame | None = None,
    best_first: bool = True,
    shared: str | None = None,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    item_block_rows: int = ITEM_BLOCK_ROWS,
    excluded_by: str | None = None,
    returned: Sequence[str] = (),
) -> DataFrame:
    """``[segment,] query_id, item_id, score, rank`` of the best k items per query.

    ``queries`` and ``items`` hold the id and the columns the kernel reads; ``segment``
    names a column of both sides that must be equal. ``k`` is a number or a column of ``queries`` with each query's
    own one. ``excluded`` holds (query_id, item_id) pairs that must not compete, or pairs of ``excluded_by``, a column of
    the queries that many of them may share, and item_id. Ids may repeat over rows (one row per
    term). ``returned`` names more columns that the kernel gives with each row, of the items or ``_k``. ``shared`` names a column of both sides: an item's row is of use only to queries with the same
    value, and is sent only to blocks that have one.
    """
    seg = F.col(segment).cast("string") if segment else F.lit("")
    left = queries.withColumn("_seg", seg).withColumn("_k", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int"))
    if isinstance(k, str):
        left = left.drop(k)
    right = items.withColumn("_seg", seg)
    most = k if isinstance(k, int) else left.agg(F.max("_k")).first()[0] or 0
    left, right, stripes = _with_block_counts(
        left, right, segment is not None, query_block_rows, item_block_rows, item_id, most
    )
    left = left.withColumn("_qb", _block(query_id, "_nq"))
    right = right.withColumn("_ib", _block(item_id, "_ni"))
    if shared is None:
        spread_right = right.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    else:
        # without segments the column alone is the key, so items bucketed by it are joined where they lie
        on = ["_seg", shared] if segment else [shared]
        asked = cut_lineage(left.select(*on, F.col("_qb").alias("_to")).distinct())
        if asked.count() <= BROADCAST_SEGMENTS:  # few queries hold few values, and items without one are not shuffled at all
            asked = F.broadcast(asked)
        spread_right = right.join(asked, on).withColumn("_qb", F.col("_to")).drop("_to")
    spread_right = spread_right.drop("_nq", "_ni")
    placed = None
    if excluded is not None:
        owner = excluded_by or query_id
        placed = left.select("_seg", owner, "_qb", "_ni").distinct().join(
            excluded.select(owner, F.col(item_id).alias("_out")), owner
        )
        placed = placed.withColumn("_ib", _block("_out", "_ni"))

    keys = ["_seg", "_qb", "_ib"]
    query_fields = [T.StructField("_seg", T.StringType()), T.StructField(query_id, queries.schema[query_id].dataType)]
    schema = T.StructType([
        *query_fields,
        T.StructField(item_id, items.schema[item_id].dataType),
        T.StructField(score, T.DoubleType()),
        *(T.StructField(c, T.IntegerType() if c == "_k" else items.schema[c].dataType) for c in returned),
    ])

    def search(asking: DataFrame, sketch: bool) -> DataFrame:
        spread_left = asking.withColumn("_ib", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)))
        spread_left = spread_left.withColumn("_stripes", F.col("_ni")).withColumn(
            "_out", F.lit(None).cast(items.schema[item_id].dataType))
        if placed is not None:
            spread_left = spread_left.unionByName(placed, allowMissingColumns=True)
        return (
            spread_left.drop("_nq", "_ni").groupBy(*keys).cogroup(spread_right.groupBy(*keys))
            .applyInArrow(lambda a, b: kernel(a, b, sketch), _sketch_schema(query_fields) if sketch else schema)
        )

    left = left.withColumn("_bound", F.lit(None).cast("double"))
    if stripes > 1:
        # only values come back, sorted here once a query; fewer than k of them bound nothing
        values = search(left.where(F.col("_ni") > 1), True).groupBy("_seg", query_id).agg(
            F.max("_k").alias("_k"), F.sort_array(F.flatten(F.collect_list("_values"))).alias("_values"))
        bound = cut_lineage(values.select(
            "_seg", query_id, (F.get("_values", F.col("_k") - 1).cast("double") + BOUND_SLACK).alias("_bound")))
        left = left.drop("_bound").join(bound, ["_seg", query_id], "left")
    found = search(left, False)
    by = F.col(score).desc() if best_first else F.col(score).asc()
    if segment:  # dealt by query alone, so that steps by query after this one need no further exchange
        found = found.repartition(query_id)
    ranked = top_k(found, ["_seg", query_id], [by, F.col(item_id).asc()], most)
    if "_k" in returned:
        ranked = ranked.where(F.col("rank") <= F.col("_k")).drop("_k")
    elif isinstance(k, str):  # a query's own k; ranks above the largest are gone by now
        own = left.select("_seg", query_id, "_k").distinct()
        ranked = ranked.join(own, ["_seg", query_id]).where(F.col("rank") <= F.col("_k")).drop("_k")
    if segment:
        return ranked.withColumnRenamed("_seg", segment) if segment not in ranked.columns else ranked
    return ranked.drop("_seg")


def _sketch_schema(query_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([
        *query_fields, T.StructField("_k", T.IntegerType()), T.StructField("_values", T.ArrayType(T.FloatType()))])


# --- helpers the kernels share -----------------------------------------------------
def split_left(left: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Query rows and exclusion rows of one block."""
    is_out = pc.is_valid(left.column("_out"))
    return left.filter(pc.invert(is_out)), left.filter(is_out)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix, without per-row objects."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    widths = pc.min_max(pc.list_value_length(whole)).as_py()
    if whole.null_count or widths["min"] != widths["max"]:
        raise ValueError(f"vectors must have one length, found {widths['min']} to {widths['max']} and {whole.null_count} nulls")
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length stay zero."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def best_rows(scores: np.ndarray, k: np.ndarray, bound: np.ndarray | None = None) -> list[np.ndarray]:
    """Per row, columns of its ``k`` smallest finite scores within its ``bound``; ties go to the lower column."""
    width = scores.shape[1]
    limit = np.full(len(scores), np.inf) if bound is None else np.where(np.isnan(bound), np.inf, bound)
    for own in np.unique(k[(k < width) & (k > 0)]).tolist():
        rows = np.flatnonzero(k == own)
        limit[rows] = np.minimum(limit[rows], np.partition(scores[rows], own - 1, axis=1)[:, own - 1])
    picked = []
    for i, row in enumerate(scores):
        columns = np.flatnonzero((row <= limit[i]) & np.isfinite(row))
        picked.append(columns[np.argsort(row[columns], kind="stable")][:k[i]])
    return picked


def stripe_share(k: np.ndarray, stripes: int) -> np.ndarray:
    """How many of a query's k best lie in one of ``stripes`` hashed blocks, by four standard deviations at most."""
    mean = k / max(1, stripes)
    return np.minimum(k, np.ceil(mean + 4 * np.sqrt(mean) + 4).astype(np.int64))


def asked_k(queries: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Each query row's k and bound (NaN if none), and the number of item blocks."""
    bound = queries.column("_bound").to_numpy().astype(float)
    return queries.column("_k").to_numpy().astype(np.int64), bound, queries.column("_stripes")[0].as_py()


def sketch_table(seg: str, query_id: str, query_ids, k, values: list[np.ndarray]) -> pa.Table:
    """The best values of every query of a block pair, without ids, in single precision and rounded up."""
    flat = np.concatenate(values) if values else np.empty(0)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.table({
        "_seg": pa.array([seg] * len(values), pa.string()), query_id: query_ids,
        "_k": pa.array(k, pa.int32()),
        "_values": pa.ListArray.from_arrays(ends, np.nextafter(flat.astype(np.float32), np.float32(np.inf))),
    })


def empty_sketch(query_id: str, left: pa.Table) -> pa.Table:
    return sketch_table("", query_id, pa.array([], left.schema.field(query_id).type), [], [])


def empty_result(seg_name: str, left: pa.Table, right: pa.Table, names: Sequence[str], returned: Sequence[str] = ()) -> pa.Table:
    query_id, item_id, score = names
    return pa.table({
        seg_name: pa.array([], pa.string()),
        query_id: pa.array([], left.schema.field(query_id).type),
        item_id: pa.array([], right.schema.field(item_id).type),
        score: pa.array([], pa.float64()),
        **{c: pa.array([], pa.int32() if c == "_k" else right.schema.field(c).type) for c in returned},
    })


def result_table(seg: str, names: Sequence[str], query_ids, item_ids, scores, returned: dict | None = None) -> pa.Table:
    query_id, item_id, score = names
    return pa.table({
        "_seg": pa.array([seg] * len(scores), pa.string()),
        query_id: query_ids,
        item_id: item_ids,
        score: pa.array(scores, pa.float64()),
        **(returned or {}),
    })


def chunk_rows(width: int) -> int:
    """Query rows per matrix product, so that one product stays small."""
    return max(1, _CHUNK_CELLS // max(1, width))
