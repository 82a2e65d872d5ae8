"""Nearest-vector search: exact over block pairs, and through cells."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators import blocks
from pairwright.operators.skew import top_k

#: Pairs scored in double precision at a time.
_EXACT_PAIRS = 16_384
#: Items of which a first pass over long stripes looks at the nearest only.
_PER_GROUP = 32


def _hide(near: np.ndarray, owners: np.ndarray, columns: np.ndarray, edges: np.ndarray) -> None:
    """Take away the columns that each row's owner excludes; -1 excludes none."""
    order = np.argsort(owners, kind="stable")
    present, first = np.unique(owners[order], return_index=True)
    for owner, mine in zip(present.tolist(), np.split(order, first[1:]), strict=True):
        if owner >= 0:
            near[np.ix_(mine, columns[edges[owner]:edges[owner + 1]])] = np.inf


def cosine_kernel(
    query_id: str, item_id: str, query_vector: str, item_vector: str,
    score: str, band: tuple[float, float] | None = None, distance: bool = True,
    skip_self: bool = False, excluded_by: str | None = None, returned: Sequence[str] = (),
) -> blocks.Kernel:
    """Best k by cosine inside one block pair; the band is applied before the cut.

    Products of single precision rule pairs out, with their largest error to spare; what is left is scored in double
    precision and decided by that.
    """
    names, owner = (query_id, item_id, score), excluded_by or query_id

    def run(left: pa.Table, right: pa.Table, sketch: bool = False) -> pa.Table:
        queries, outs = blocks.split_left(left)
        if queries.num_rows == 0 or right.num_rows == 0:
            if sketch:
                return blocks.empty_sketch(query_id, left)
            return blocks.empty_result("_seg", left, right, names, returned)
        k, bound, stripes = blocks.asked_k(queries)
        seg = queries.column("_seg")[0].as_py()
        order = pc.sort_indices(right.column(item_id))
        items = right.take(order)
        item_ids = items.column(item_id)
        base = blocks.unit_rows(blocks.matrix(items.column(item_vector)))
        query_ids = queries.column(query_id)
        rows = blocks.unit_rows(blocks.matrix(queries.column(query_vector)))
        base_short, rows_short = base.astype(np.float32).T, rows.astype(np.float32)
        slack = (rows.shape[1] + 8) * 1.2e-7  # rounding of a product of unit vectors and of both of them
        who = pc.unique(outs.column(owner))
        out_col = pc.fill_null(pc.index_in(outs.column("_out"), item_ids.combine_chunks()), -1).to_numpy()
        out_who = pc.index_in(outs.column(owner), who).to_numpy()
        by_who = np.argsort(out_who, kind="stable")
        by_who = by_who[out_col[by_who] >= 0]
        out_col, edges = out_col[by_who], np.searchsorted(out_who[by_who], np.arange(len(who) + 1))
        owners = pc.fill_null(pc.index_in(queries.column(owner), who), -1).to_numpy()
        own = pc.fill_null(pc.index_in(query_ids, item_ids.combine_chunks()), -1).to_numpy() if skip_self else None
        width = len(base)
        wanted = np.minimum(blocks.stripe_share(k, stripes) if sketch else k, width)
        best, q_take, i_take, values = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        step = blocks.chunk_rows(width)
        for start in range(0, len(rows), step):
            part = slice(start, start + step)
            near = rows_short[part] @ base_short
            np.subtract(np.float32(1), near, out=near)
            if band is not None:  # a bound counts only what is surely inside, a result all that may be
                room = -slack if sketch else slack
                near[(near > 1 - band[0] + room) | (near < 1 - band[1] - room)] = np.inf
            if len(out_col):
                _hide(near, owners[part], out_col, edges)
            if own is not None:
                found = np.flatnonzero(own[part] >= 0)
                near[found, own[part][found]] = np.inf
            want = wanted[part]
            if sketch:
                picked = [np.empty(0)] * len(near)
                for some in np.unique(want[want > 0]).tolist():
                    asking = np.flatnonzero(want == some)
                    those = near if len(asking) == len(near) else near[asking]
                    if width >= 16 * some * _PER_GROUP:  # the least of a group each: values of different items, hardly above the best
                        those = those[:, :width // _PER_GROUP * _PER_GROUP].reshape(len(asking), _PER_GROUP, -1).min(axis=1)
                    lowest = np.partition(those, some - 1, axis=1)[:, :some].astype(np.float64) + slack
                    for at, row in zip(asking.tolist(), lowest, strict=True):
                        picked[at] = row[np.isfinite(row)]
                best += picked
                continue
            limit = np.where(np.isnan(bound[part]), np.inf, bound[part] + slack)
            open_ended = np.isinf(limit) & (want < width)
            for some in np.unique(want[open_ended & (want > 0)]).tolist():
                asking = np.flatnonzero(open_ended & (want == some))
                limit[asking] = np.partition(near[asking], some - 1, axis=1)[:, some - 1] + 2 * slack
            limit[np.isnan(limit)] = np.inf
            limit[want <= 0] = -np.inf
            limit = np.nextafter(np.minimum(limit, np.finfo(np.float32).max / 2).astype(np.float32), np.float32(np.inf))
            r, c = np.nonzero(near <= limit[:, None])
            cos = np.empty(len(r))
            for at in range(0, len(r), _EXACT_PAIRS):
                few = slice(at, at + _EXACT_PAIRS)
                cos[few] = np.einsum("ij,ij->i", rows[start + r[few]], base[c[few]])
            lost = np.round(1.0 - cos, blocks.SCORE_DIGITS)
            if band is not None:
                inside = np.round(cos, blocks.SCORE_DIGITS)
                inside = (inside >= band[0]) & (inside <= band[1])
                r, c, lost = r[inside], c[inside], lost[inside]
            by_score = np.lexsort((c, lost, r))
            r, c, lost = r[by_score], c[by_score], lost[by_score]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < want[r]
            kept &= np.isnan(bound[part][r]) | (lost <= bound[part][r])
            q_take.append(start + r[kept])
            i_take.append(c[kept])
            values.append(lost[kept])
        if sketch:
            return blocks.sketch_table(seg, query_id, query_ids, k, best)
        result, asked, met = np.concatenate(values), pa.array(np.concatenate(q_take)), pa.array(np.concatenate(i_take))
        return blocks.result_table(
            seg, names, query_ids.take(asked), item_ids.take(met),
            result if distance else np.round(1.0 - result, blocks.SCORE_DIGITS),
            {c: queries.column(c).take(asked) if c == "_k" else items.column(c).take(met) for c in returned},
        )

    return run


def vector_topk_join(
    queries: DataFrame, items: DataFrame, k: int | str, *,
    query_id: str = "query_id", item_id: str = "item_id",
    query_vector: str = "query_vector", item_vector: str = "item_vector",
    score: str = "distance", excluded: DataFrame | None = None, segment: str | None = None,
    band: tuple[float, float] | None = None, skip_self: bool = False, similarity: bool = False,
    query_block_rows: int = blocks.QUERY_BLOCK_ROWS, item_block_rows: int = blocks.ITEM_BLOCK_ROWS,
    excluded_by: str | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """The k nearest items of every query by cosine distance, exactly.

    ``k`` is a number, or a column of ``queries`` if each asks for its own number. Exclusions, band and segment take effect before the cut to k. Distances are rounded to
    nine digits and equal distances are ordered by item id. ``excluded`` holds pairs of query and item, or of ``excluded_by``,
    a column of the queries, and item. ``carry`` names columns of the items that the found rows bring along. Vectors without length have
    similarity 0 to everything; rows with a null vector take no part.
    """
    cols = [segment] if segment else []
    own = [k] if isinstance(k, str) else []
    queries, items = queries.where(F.col(query_vector).isNotNull()), items.where(F.col(item_vector).isNotNull())
    returned = [*carry, "_k"] if own else [*carry]
    kernel = cosine_kernel(
        query_id, item_id, query_vector, item_vector, score, band, not similarity, skip_self, excluded_by, returned
    )
    who = [excluded_by] if excluded_by and excluded_by != query_id else []
    return blocks.blocked_top_k(
        queries.select(*cols, *own, *who, query_id, query_vector), items.select(*cols, *carry, item_id, item_vector),
        kernel, k, query_id=query_id, item_id=item_id, score=score, segment=segment,
        excluded=excluded, best_first=similarity,
        query_block_rows=query_block_rows, item_block_rows=item_block_rows, excluded_by=excluded_by, returned=returned,
    )


def fit_cells(items: DataFrame, vector: str, cells: int = 100, seed: int = 7,
              rounds: int = 10) -> list[list[float]]:
    """Cell centres by k-means on unit vectors; only the centres reach the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import Normalizer

    features = items.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="features").transform(features).select("features")
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(unit)
    return [[float(x) for x in centre] for centre in model.clusterCenters()]


def with_cells(df: DataFrame, vector: str, centres: list[list[float]], probes: int = 1,
               name: str = "cell") -> DataFrame:
    """One row per probed cell: the ``probes`` centres nearest by cosine, with the distance.

    ``centres`` is bounded by the chosen cell count, so it travels with the task.
    """
    grid = blocks.unit_rows(np.array(centres, dtype=np.float64))

    @F.pandas_udf(f"array<struct<{name}: int, cell_distance: double>>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = blocks.unit_rows(np.stack(batch.to_numpy()).astype(np.float64))
            away = np.round(1.0 - rows @ grid.T, blocks.SCORE_DIGITS)
            best = np.argsort(away, axis=1, kind="stable")[:, :probes]
            yield pd.Series([
                [{name: int(c), "cell_distance": float(away[i, c])} for c in row]
                for i, row in enumerate(best)
            ])

    return df.withColumn("_c", F.explode(nearest(vector))).select(
        *df.columns, f"_c.{name}", "_c.cell_distance"
    )


def vector_topk_cells(
    queries: DataFrame, items: DataFrame, k: int, centres: list[list[float]], *,
    probes: int = 10, exact: bool = False, query_id: str = "query_id", item_id: str = "item_id",
    query_vector: str = "query_vector", item_vector: str = "item_vector",
    score: str = "distance", excluded: DataFrame | None = None, skip_self: bool = False,
) -> DataFrame:
    """Top k through cells: only the ``probes`` nearest cells of a query are searched.

    With ``exact`` every further cell that could still hold a nearer item is searched too:
    a cell is skipped only if the angle to its centre minus its widest angle is larger than
    the angle of the k-th item found so far, so the result equals the full search.
    """
    placed = with_cells(items.select(item_id, item_vector), item_vector, centres)
    names = dict(query_id=query_id, item_id=item_id, query_vector=query_vector,
                 item_vector=item_vector, score=score, excluded=excluded,
                 skip_self=skip_self, segment="cell")
    asked = queries.select(query_id, query_vector)
    order = [F.col(score).asc(), F.col(item_id).asc()]
    near = with_cells(asked, query_vector, centres, probes)
    first = vector_topk_join(near, placed, k, **names).drop("rank")
    if not exact:
        return top_k(first.drop("cell"), [query_id], order, k)

    def angle(column):
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - column)))

    found = top_k(first, [query_id], order, k)
    reach = found.groupBy(query_id).agg(
        F.when(F.count(F.lit(1)) >= k, angle(F.max(score))).alias("_reach")
    )
    widths = placed.groupBy("cell").agg(F.max(angle(F.col("cell_distance"))).alias("_width"))
    every = with_cells(asked, query_vector, centres, len(centres))
    seen = near.select(query_id, "cell")
    further = (
        every.join(reach, query_id, "left")
        .join(F.broadcast(widths), "cell")  # one row per cell centre
        .where(F.col("_reach").isNull()
               | (angle(F.col("cell_distance")) - F.col("_width") <= F.col("_reach") + 1e-6))
        .join(seen, [query_id, "cell"], "left_anti")
        .select(query_id, query_vector, "cell", "cell_distance")
    )
    second = vector_topk_join(further, placed, k, **names).drop("rank")
    return top_k(first.unionByName(second).drop("cell"), [query_id], order, k)


def recall_at_k(approximate: DataFrame, exact: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """Share of the exact result an approximate result contains, over all queries."""
    hits = exact.select(query_id, item_id).join(
        approximate.select(query_id, item_id).withColumn("_hit", F.lit(1)),
        [query_id, item_id], "left",
    )
    return hits.agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("expected")).withColumn(
        "recall", F.col("hits") / F.col("expected")
    )


def _partial_moments(vector: str, label: str | None):
    """Per task and label: row count, vector sum, norms and the matrix of products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = blocks.matrix(pa.chunked_array([batch.column(vector)]))
            groups = (
                np.array(batch.column(label).to_pylist(), dtype=object)
                if label else np.zeros(len(rows), dtype=object)
            )
            for group in set(groups.tolist()):
                part = rows[groups == group]
                squares = np.sum(part * part, axis=1)
                state = sums.setdefault(group, [0, 0.0, 0.0, 0.0, 0.0, 0.0])
                state[0] += len(part)
                state[1] = state[1] + part.sum(axis=0)
                state[2] += float(np.sqrt(squares).sum())
                state[3] += float(squares.sum())
                state[4] += float((squares ** 2).sum())
                if label is None:
                    state[5] = state[5] + part.T @ part
        for group, (n, total, norms, squares, fourth, gram) in sums.items():
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([None if label is None else str(group)], pa.string()),
                "n": pa.array([n], pa.int64()),
                "total": pa.array([total.tolist()], pa.list_(pa.float64())),
                "norms": pa.array([norms], pa.float64()),
                "squares": pa.array([squares], pa.float64()),
                "fourth": pa.array([fourth], pa.float64()),
                "gram": pa.array(
                    [gram.ravel().tolist() if label is None else []], pa.list_(pa.float64())
                ),
            })

    return run


_MOMENTS = (
    "label string, n bigint, total array<double>, norms double, squares double, "
    "fourth double, gram array<double>"
)


def _squared_length_of_sum(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Sum arrays element by element over tasks, then the squared length of the sum."""
    parts = df.select(*by, F.posexplode(column).alias("_at", "_x"))
    return (
        parts.groupBy(*by, "_at").agg(F.sum("_x").alias("_x"))
        .groupBy(*by).agg(F.sum(F.col("_x") * F.col("_x")).alias(f"{column}_squared"))
    )


def embedding_diagnostics(df: DataFrame, vector: str = "embedding", item_id: str = "id") -> DataFrame:
    """Norms and pairwise dot products of a vector set as one row.

    Mean and deviation come from the vector sum and the matrix of coordinate products in one
    pass; only the extremes need block pairs, and each block pair returns just two numbers.
    """
    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(
        _partial_moments(vector, None), _MOMENTS
    )
    whole = parts.withColumn("_one", F.lit(1))
    base = whole.groupBy("_one").agg(
        F.sum("n").alias("n"), F.max(F.size("total")).alias("dim"), F.sum("norms").alias("norms"),
        F.sum("squares").alias("squares"), F.sum("fourth").alias("fourth"),
    )
    total = _squared_length_of_sum(whole, "total", ["_one"])
    gram = _squared_length_of_sum(whole, "gram", ["_one"])
    extremes = similarity_extremes(df, vector, item_id).withColumn("_one", F.lit(1))
    joined = base.join(total, "_one").join(gram, "_one").join(extremes, "_one")
    n = F.col("n").cast("double")
    pairs = n * (n - 1)
    mean = (F.col("total_squared") - F.col("squares")) / pairs
    second = (F.col("gram_squared") - F.col("fourth")) / pairs
    norm_mean = F.col("norms") / n
    return joined.select(
        F.col("n").alias("num_embeddings"), F.col("dim").alias("embedding_dim"),
        norm_mean.alias("norm_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - norm_mean * norm_mean)).alias("norm_std"),
        mean.alias("similarity_mean"),
        F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)).alias("similarity_std"),
        "similarity_min", "similarity_max",
    )


def similarity_extremes(
    df: DataFrame, vector: str, item_id: str, block_rows: int = 4096
) -> DataFrame:
    """Smallest and largest dot product of two different rows, two numbers per block pair."""
    rows = df.select(F.col(item_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    count = rows.agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_n"))
    placed = rows.withColumn("_n", count.scalar()).withColumn(
        "_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int")
    )
    left = placed.withColumn("_c", F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)))
    right = placed.withColumnRenamed("_b", "_c").withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.col("_c")))
    )

    def extremes(key, a: pa.Table, b: pa.Table) -> pa.Table:
        low, high = np.inf, -np.inf
        if a.num_rows and b.num_rows:
            x, y = blocks.matrix(a.column("_v")), blocks.matrix(b.column("_v"))
            same = key[0].as_py() == key[1].as_py()
            ids = pc.index_in(a.column("_id"), b.column("_id").combine_chunks()).to_numpy() if same else None
            step = blocks.chunk_rows(len(y))
            for start in range(0, len(x), step):
                dots = x[start:start + step] @ y.T
                keep = np.ones(dots.shape, dtype=bool)
                if same:
                    keep[np.arange(len(dots)), ids[start:start + len(dots)].astype(np.int64)] = False
                if keep.any():
                    low, high = min(low, dots[keep].min()), max(high, dots[keep].max())
        found = np.isfinite(low)
        return pa.table({
            "low": pa.array([low] if found else [], pa.float64()),
            "high": pa.array([high] if found else [], pa.float64()),
        })

    pairs = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(
        extremes, "low double, high double"
    )
    return pairs.agg(F.min("low").alias("similarity_min"), F.max("high").alias("similarity_max"))


def class_separation(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean dot product inside labels and across labels, from one vector sum per label."""
    parts = df.select(
        F.col(vector).cast("array<double>").alias(vector), F.col(label).cast("string").alias(label)
    ).mapInArrow(_partial_moments(vector, label), _MOMENTS)
    sums = parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    lengths = _squared_length_of_sum(parts, "total", ["label"])
    intra = sums.join(lengths, "label").agg(
        F.sum("n").alias("n"), F.sum("squares").alias("squares"),
        F.sum((F.col("total_squared") - F.col("squares")) / 2).alias("intra_sum"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("intra_pairs"),
    ).withColumn("_one", F.lit(1))
    whole = _squared_length_of_sum(parts.withColumn("_one", F.lit(1)), "total", ["_one"])
    n = F.col("n").cast("double")
    inter_sum = (F.col("total_squared") - F.col("squares")) / 2 - F.col("intra_sum")
    inter_pairs = n * (n - 1) / 2 - F.col("intra_pairs")
    means = intra.join(whole, "_one").select(
        F.when(F.col("intra_pairs") > 0, F.col("intra_sum") / F.col("intra_pairs"))
        .alias("intra_class_similarity"),
        F.when(inter_pairs > 0, inter_sum / inter_pairs).alias("inter_class_similarity"),
    )
    return means.withColumn(
        "class_separation", F.col("intra_class_similarity") - F.col("inter_class_similarity")
    )


def pool_vectors(
    members: DataFrame, vectors: DataFrame, group: str, key: str, vector: str, dim: int,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Mean vector of each group's known members; groups without any get zeros.

    A group's sums travel as one row with a column for each of the ``dim`` places, not as a row for each place; a longer
    vector is an error.
    """
    size = F.size(vector)
    checked = F.when(size > dim, F.raise_error(F.concat(F.lit(f"a vector longer than {dim}: "), size.cast("string")))).otherwise(size)
    matched = members.select(group, key).join(vectors.select(key, vector), key)
    places = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_x{i}") for i in range(dim)]
    means = (
        matched.groupBy(group).agg(F.max(checked).alias("_size"), *places).where(F.col("_size") > 0)
        .select(group, F.slice(F.array(*[f"_x{i}" for i in range(dim)]), F.lit(1), F.col("_size")).alias(vector))
    )
    everyone = (groups if groups is not None else members).select(group).distinct()
    zeros = F.array_repeat(F.lit(0.0), dim)
    return everyone.join(means, group, "left").withColumn(vector, F.coalesce(vector, zeros))
