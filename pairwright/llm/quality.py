"""Compression classifier for text quality.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed in blocks with
either one; the normalised difference of the compressed sizes, together with the compression ratio, is
calibrated to a probability by logistic regression on labelled rows that trained no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bound_batches, stored, text_of
from pairwright.llm.samples import held_out, id_bucket, labelled_ids, sampled_texts, window

#: Labelled documents of each class that train and calibrate, half of them each.
PER_CLASS = 1500
#: Characters that one text gives to a dictionary; calibration and scoring read whole texts.
DICT_CHARS = 8192
BLOCK = 2048
DICT_BYTES = 65536
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and calibration; a missing dictionary means the constant score ``base``."""

    good: bytes | None
    bad: bytes | None
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    base: float = 0.5


def _blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i:i + BLOCK] for i in range(0, max(len(data), 1), BLOCK)]


def _dictionary(texts: list[str]) -> bytes | None:
    samples = [b for t in texts for b in _blocks(t) if b]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as the dictionary
        return b"".join(samples)[-DICT_BYTES:]


class _Sizes:
    """Compressed sizes with the good and the bad dictionary."""

    def __init__(self, model: QualityModel):
        self.compressors = []
        for data in (model.good, model.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, ...]:
        blocks = _blocks(text)
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        gap = (bad - good) / (bad + good)
        ratio = float(np.log((good + bad) / 2 / max(1, sum(map(len, blocks)))))
        return gap, ratio, gap * gap, ratio * ratio, gap * ratio


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge-regularised logistic regression, by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class whose id bucket is not ``rest``.

    One class only gives its label as a constant score, no labels give 0.5.
    """
    bound_batches(docs.sparkSession)
    ids = labelled_ids(labels, "quality", id_bucket(F.col("doc_id"), modulus) != rest, per_class)
    sample = stored(sampled_texts(docs, ids), "quality-sample")
    parts = sample.withColumn("first", F.col("at") % 2 == 1).groupBy("y", "first").count().collect()
    counts = {(r.y, r.first): r["count"] for r in parts}
    rows = sum(counts.values())
    share = sum(n for (y, _), n in counts.items() if y == 1) / rows if rows else 0.5
    if len({y for y, _ in counts}) < 2:
        return QualityModel(None, None, base=share)
    parted = all(counts.get((y, True), 0) >= 10 for y in (0, 1))  # too few to part: the same rows train and calibrate
    pieces = sample.where("at % 2 = 1" if parted else "true").select(
        "doc_id", "y", window(F.col("text"), F.col("doc_id"), DICT_CHARS).alias("text")).toPandas().sort_values("doc_id")
    good, bad = (_dictionary(pieces.loc[pieces["y"] == k, "text"].tolist()) for k in (1, 0))
    if good is None or bad is None:
        return QualityModel(None, None, base=share)
    check = sample.where("at % 2 = 0" if parted else "true").select(
        "doc_id", "y", _measured(QualityModel(good, bad))(F.col("text")).alias("x")).toPandas().sort_values("doc_id")
    x = np.array(check["x"].tolist())
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = fit_logistic((x - mean) / scale, check["y"].to_numpy(float))
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(weights), share)


def _measured(model: QualityModel):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model)
        for batch in texts:
            yield pd.Series([list(sizes.features(t)) for t in batch], dtype=object)

    return F.pandas_udf(run, "array<double>")


def _scorer(model: QualityModel):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model) if model.good is not None else None
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for batch in texts:
            if sizes is None:
                yield pd.Series(np.full(len(batch), model.base))
                continue
            x = (np.array([sizes.features(t) for t in batch]).reshape(len(batch), -1) - mean) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return F.pandas_udf(run, "double")


def quality_scores(docs: DataFrame, model: QualityModel, modulus: int = 4, rest: int = 2, cutoff: float = 0.7,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): whole texts scored; null texts count as empty ones.

    Repeated rows and null ids are scored each (a null id is not held out); extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    scored = docs.select(F.col(doc_id).alias("doc_id"), _scorer(model)(text_of(F.col(text))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))
