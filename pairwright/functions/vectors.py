"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import fixed_values as fv


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors, 0 when either has no length."""
    lengths = norm(left) * norm(right)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(left, right) / lengths)


def normalize_embedding(value: Column, dim: int = fv.VECTOR_DIM, text: bool = False) -> Column:
    """Pad with zeros or truncate to ``dim``; ``text`` columns hold ``[x, y, ...]``."""
    vector = value
    if text:
        pieces = F.split(F.regexp_replace(value, r"^[\[\]]+|[\[\]]+$", ""), ",")
        vector = F.transform(
            F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.trim(p).cast("double")
        )
    padded = F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dim))
    return F.slice(padded, 1, dim)
