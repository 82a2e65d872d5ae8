"""Toxicity by a counterfactual-regularised linear classifier.

Features are the densities of words and of their leading letters. An L1-regularised logistic regression is
fitted by accelerated proximal gradient steps; each sentence of a labelled text that mentions a group is copied with
the identity terms swapped and the squared change of the logit is penalised, so mentioning one group or another
does not move the score. The groups are the given terms and those learnt from the labelled texts: words that are as
frequent in one class as in the other and that stand between the same words, so one may take another's place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bound_batches, stored, text_of
from pairwright.llm.samples import held_out, id_bucket, labelled_ids, sampled_texts

#: Labelled documents of each class that train, with their whole texts.
PER_CLASS = 2000
FEATURES = 2000
LEAST_DOCS = 5
STEPS = 250
L1 = 5e-4
PENALTY = 5.0
STEMS = (4, 5, 6, 7)
#: Learnt groups: frequent words looked at, largest size, least likeness of contexts, highest z-score of the class difference.
TERMS = 200
GROUP_SIZE = 6
LIKENESS = 0.5
NEUTRAL_Z = 2.0
#: Part of a density in which changes are counted, so that sums are whole numbers.
UNIT = 1e-5
#: Words a Python worker remembers before it starts anew.
REMEMBERED = 400_000

# Identity terms; the terms of one line may stand for each other.
IDENTITY_TERMS = (
    "women men girls boys",
    "woman man girl boy",
    "muslim christian jewish hindu buddhist atheist",
    "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab african european",
    "gay straight lesbian bisexual transgender queer",
    "immigrants refugees natives foreigners",
    "disabled deaf blind elderly young",
)
GROUPS = tuple(tuple(line.split()) for line in IDENTITY_TERMS)
Groups = tuple[tuple[str, ...], ...]
_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Weights, and how many swapped sentences the fit saw with the root mean square change of their logit."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0
    change: float = 0.0
    groups: tuple[tuple[str, ...], ...] = ()


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _names(word: str) -> list[str]:
    """The word itself and its stems."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) > n)]


def swap_identity(words: Iterable[str], shift: int = 1, groups: Groups = GROUPS) -> list[str]:
    """The words with every identity term replaced by another one of its group."""
    other = {t: g[(i + shift) % len(g)] for g in groups for i, t in enumerate(g)}
    return [other.get(w, w) for w in words]


def _density(count: float, words: int) -> float:
    return min(1.0, 100.0 * count / (words + 20))


def _row(words: list[str], index: dict[str, int]) -> dict[int, float]:
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        for name in _names(word):
            if name in index:
                counts[index[name]] += n
    return {j: _density(n, len(words)) for j, n in counts.items()}


def _matrix(rows: list[dict[int, float]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width), np.float32)
    for i, row in enumerate(rows):
        x[i, list(row)] = list(row.values())
    return x


def _names_in(text: str) -> set[str]:
    return {name for w in set(_words(text)) for name in _names(w)}


def _changes(texts: Iterable[str], index: dict[str, int], groups: Groups) -> tuple[int, dict[tuple[int, int], int]]:
    """Swapped sentences, and the sum of products of their feature changes, in whole units."""
    others = [{t: g[(i + shift) % len(g)] for g in groups for i, t in enumerate(g)} for shift in (1, 2)]
    pairs, sums = 0, Counter()
    for text in texts:
        for sentence in _SENTENCE_END.split(text):
            words = _words(sentence)
            if not any(w in others[0] for w in words):
                continue
            before = _row(words, index)
            for other in others:
                pairs += 1
                after = _row([other.get(w, w) for w in words], index)
                moved = {j: round((after.get(j, 0.0) - before.get(j, 0.0)) / UNIT) for j in before.keys() | after.keys()}
                moved = sorted((j, v) for j, v in moved.items() if v)
                for j, v in moved:
                    for k, u in moved:
                        sums[j, k] += v * u
    return pairs, sums


def _contexts(texts: Iterable[str], terms: set[str]) -> Counter[tuple[str, str]]:
    """(term, neighbour) counts; the neighbour is a term before or after it, or a blank for any other word."""
    seen: Counter[tuple[str, str]] = Counter()
    for text in texts:
        words = _words(text)
        for i, word in enumerate(words):
            if word in terms:
                for side, at in (("<", i - 1), (">", i + 1)):
                    near = words[at] if 0 <= at < len(words) else ""
                    seen[word, side + (near if near in terms else "")] += 1
    return seen


def learnt_groups(contexts: dict[tuple[str, str], int], order: list[str], size: int = GROUP_SIZE, likeness: float = LIKENESS) -> Groups:
    """Groups of terms with like contexts, formed in the given order: a term takes the likest ones still free.

    Contexts are compared by the cosine of the positive part of their pointwise mutual information.
    """
    slots = {s: j for j, s in enumerate(sorted({s for _, s in contexts if len(s) > 1}))}
    at = {t: i for i, t in enumerate(order)}
    counts = np.zeros((len(order), len(slots)))
    for (term, slot), n in contexts.items():
        if term in at and slot in slots:
            counts[at[term], slots[slot]] = n
    total = max(counts.sum(), 1.0)
    expected = np.outer(counts.sum(axis=1), counts.sum(axis=0)) / total
    info = np.log(np.divide(counts, expected, out=np.ones_like(counts), where=counts > 0)).clip(min=0)
    info /= np.linalg.norm(info, axis=1, keepdims=True) + 1e-12
    like = np.round(info @ info.T, 9)
    free, groups = set(range(len(order))), []
    for i in range(len(order)):
        if i in free:
            near = sorted((j for j in free if j != i and like[i, j] >= likeness), key=lambda j: (-like[i, j], j))[:size - 1]
            free -= {i, *near}
            if near:
                groups.append((order[i], *(order[j] for j in near)))
    return tuple(groups)


def train(texts: list[str], labels: list[int], penalty: float = PENALTY, l1: float = L1, most: int = FEATURES,
          groups: Groups = GROUPS) -> ToxicityModel:
    """Fit on few labelled texts in this process; ``fit_toxicity`` does the same on Spark and learns groups."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        return _constant(labels)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        seen[label].update(_names_in(text))
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    scored = []
    for name in set(seen[0]) | set(seen[1]):
        a, b = seen[1][name], seen[0][name]
        if a + b >= LEAST_DOCS:
            p = (a + b) / (n0 + n1)
            scored.append((-abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9), name))
    names = _with_terms([name for _, name in sorted(scored)[:most]], groups)
    index = {name: j for j, name in enumerate(names)}
    pairs, sums = _changes(texts, index, groups)
    return _fit(names, [_row(_words(t), index) for t in texts], y, pairs, sums, penalty, l1, groups)


def _constant(labels: list[int]) -> ToxicityModel:
    """No labels give the score 0.5, one class gives a score at its end."""
    return ToxicityModel(0.0 if not labels else (4.0 if labels[0] else -4.0))


def _with_terms(names: list[str], groups: Groups) -> list[str]:
    known = set(names)
    return names + sorted({t + "$" for g in groups for t in g} - known)


def _fit(names: list[str], rows: list[dict[int, float]], y: np.ndarray, pairs: int, sums: dict[tuple[int, int], int],
         penalty: float, l1: float, groups: Groups) -> ToxicityModel:
    x = _matrix(rows, len(names))
    swaps = np.zeros((len(names), len(names)))
    for (j, k), v in sums.items():
        swaps[j, k] = v * UNIT * UNIT
    weight = penalty / max(1, pairs)
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / len(y)  # classes weigh the same
    prior = np.log((y == 1).mean() / (y == 0).mean())

    def curvature(v: np.ndarray) -> np.ndarray:
        return 0.25 * (x.T @ (share * (x @ v))) + 2 * weight * (swaps @ v)

    v = np.random.default_rng(7).standard_normal(len(names))
    top = 1e-6
    for _ in range(30):
        v = v / (np.linalg.norm(v) + 1e-12)
        v = curvature(v)
        top = max(float(np.linalg.norm(v)), 1e-6)
    step = 1 / (1.1 * (top + 0.25))
    w, b, z, bz, t = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0, 1.0
    for _ in range(STEPS):
        gap = share * (1 / (1 + np.exp(-np.clip(x @ z + bz, -30, 30))) - y)
        grad = x.T @ gap + 2 * weight * (swaps @ z)
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = bz - step * gap.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    change = float(np.sqrt(max(0.0, w @ swaps @ w) / max(1, pairs)))
    return ToxicityModel(float(b + prior), {n: float(c) for n, c in zip(names, w, strict=True) if c}, pairs, change, groups)


def _summed(rows: DataFrame, step, keys: str, value: str) -> DataFrame:
    """Counts that ``step`` makes of the texts of a batch, summed over all of them."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys.split(), value]
        for frame in frames:
            made = [(*key, n) for key, n in step(frame).items()]
            yield pd.DataFrame(made, columns=columns)

    types = {"name": "string", "y": "int", "j": "int", "k": "int", "term": "string", "slot": "string"}
    schema = ", ".join([f"{k} {types[k]}" for k in keys.split()] + [f"{value} long"])
    return rows.mapInPandas(run, schema).groupBy(*keys.split()).agg(F.sum(value).alias(value))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, per_class: int = PER_CLASS,
                 penalty: float = PENALTY, groups: Groups = GROUPS, learn: bool = True) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class whose id bucket is not ``rest``.

    Their whole texts are read in tasks; the driver gets feature rows, at most ``FEATURES`` and the terms wide.
    No labelled texts give the score 0.5, one class gives a score at its end. ``groups`` are terms that may stand for
    each other; with ``learn`` more are learnt.
    """
    bound_batches(docs.sparkSession)
    ids = labelled_ids(labels, "toxic", id_bucket(F.col("doc_id"), modulus) != rest, per_class)
    rows = stored(sampled_texts(docs, ids), "toxicity-sample")
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return _constant(list(n))

    def names(frame: pd.DataFrame) -> Counter:
        return Counter((name, label) for text, label in zip(frame["text"], frame["y"], strict=True) for name in _names_in(text))

    by_class = [F.coalesce(F.sum(F.when(F.col("y") == k, F.col("docs"))), F.lit(0)) for k in (0, 1)]
    found = _summed(rows, names, "name y", "docs").groupBy("name").agg(by_class[0].alias("b"), by_class[1].alias("a"))
    both = F.col("a") + F.col("b")
    p = both / (n[0] + n[1])
    z = F.abs(F.col("a") / n[1] - F.col("b") / n[0]) / F.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]) + 1e-9)
    scored = stored(found.where(both >= LEAST_DOCS).withColumn("z", z).withColumn("both", both), "toxicity-names")
    top = [r.name for r in scored.orderBy(F.desc("z"), "name").limit(FEATURES).collect()]
    if learn:
        given = [t + "$" for g in groups for t in g]
        neutral = scored.where(F.col("name").endswith("$") & (F.col("z") <= NEUTRAL_Z) & ~F.col("name").isin(given))
        order = [r.name[:-1] for r in neutral.orderBy(F.desc("both"), "name").limit(TERMS).collect()]
        terms = set(order)
        near = _summed(rows, lambda frame: _contexts(frame["text"], terms), "term slot", "n").collect()
        groups = (*groups, *learnt_groups({(r.term, r.slot): r.n for r in near}, order))
    every = _with_terms(top, groups)
    index = {name: j for j, name in enumerate(every)}

    def changes(frame: pd.DataFrame) -> dict:
        pairs, sums = _changes(frame["text"], index, groups)
        return {(-1, -1): pairs, **sums}

    moved = {(r.j, r.k): r.v for r in _summed(rows, changes, "j k", "v").collect()}
    pairs = moved.pop((-1, -1), 0)

    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [_row(_words(t), index) for t in batch]
            yield pd.DataFrame({"j": [list(r) for r in made], "v": [list(r.values()) for r in made]})

    wide = F.pandas_udf(features, "j array<int>, v array<float>")(F.col("text"))
    got = rows.select("doc_id", "y", wide.alias("f")).select("doc_id", "y", "f.j", "f.v").toPandas().sort_values("doc_id")
    made = [dict(zip(j, v, strict=True)) for j, v in zip(got["j"], got["v"], strict=True)]
    return _fit(every, made, got["y"].to_numpy(int), pairs, moved, penalty, L1, groups)


class _Active(dict):
    """Word -> the weighted names it holds, worked out once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(n for n in _names(word) if n in self.weights)
        self[word] = found
        return found


def _scorer(model: ToxicityModel):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        active = _Active(model.weights)
        for batch in texts:
            scores = []
            for text in batch:
                words = _words(text)
                counts: Counter[str] = Counter()
                for names in filter(None, map(active.__getitem__, words)):
                    counts.update(names)
                scores.append(model.intercept + sum(model.weights[n] * _density(c, len(words)) for n, c in counts.items()))
                if len(active) > REMEMBERED:
                    active.clear()
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(scores, float), -30, 30))))

    return F.pandas_udf(run, "double")


def toxicity_scores(docs: DataFrame, model: ToxicityModel, modulus: int = 3, rest: int = 1, cutoff: float = 0.7,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): whole texts scored; null texts count as empty ones.

    Repeated rows and null ids are scored each (a null id is not held out); extra columns are ignored.
    """
    bound_batches(docs.sparkSession)
    scored = docs.select(F.col(doc_id).alias("doc_id"), _scorer(model)(text_of(F.col(text))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))
