"""Quality rules whose cutoffs control the risk of rejecting good documents.

Every rule rejects a document whose feature lies above a cutoff. Cutoffs are chosen per stratum from a
fixed grid by testing on labelled good documents: the hypothesis "this cutoff rejects more than ``risk`` of
the stratum's good documents" has the exact binomial p-value P(Bin(n, risk) <= false rejections). Along a
rule's grid cutoffs are tested from the loosest to the tightest and the walk stops at the first that is not
significant (fixed-sequence testing); over strata and rules the level is divided by their number
(Bonferroni). So with probability 1 - ``level`` no chosen cutoff rejects more than ``risk`` of the good documents of
its stratum. Among the safe cutoffs the one is taken that parts bad from good documents best; a rule
without a useful safe cutoff is off in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import broadcast_if_small, let, same, stored, text_of

#: Rule -> cutoffs from the loosest to the tightest.
GRID = {
    "symbol_share": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.2, 0.1, 0.05),
    "mean_word_chars": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "dup_line_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_word_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "upper_share": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
}
RISK = 0.02
LEVEL = 0.05
WINDOW = 8
MIN_WORDS = 20
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def _repeat_words(words: Column) -> Column:
    """Word positions covered by windows that stand twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(
        *[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(
                x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked, count))

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes, covered))


def text_stats(text: Column) -> Column:
    """A struct of the counts in ``STATS``; words are runs without blanks, a null text has none."""
    body = text_of(text)

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(STATS, (
            F.size(words), _without(body, BLANKS), F.length(body) - _without(body, SYMBOLS),
            F.size(lines) - F.size(F.array_distinct(lines)), _repeat_words(words), F.size(lines),
            F.length(body) - _without(body, CAPITALS)), strict=True)])

    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(body, BLANK), "")
    return let(words, lambda w: let(lines, lambda x: counts(w, x)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _features(s) -> dict[str, Column]:
    return {
        "symbol_share": _share(s("n_symbols"), s("n_words")),
        "mean_word_chars": _share(s("word_chars"), s("n_words")),
        "dup_line_share": _share(s("n_dup_lines"), s("n_lines")),
        "repeat_word_share": _share(s("n_repeat_words"), s("n_words")),
        "upper_share": _share(s("n_upper"), s("word_chars")),
    }


def _base_failed(s) -> Column:
    return (s("n_words") < MIN_WORDS) | (s("n_repeat_words") * 100 > s("n_words") * 30)


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by ten; exact to about 1e-13 for x >= 1."""
    shift = sum((F.ln(x + k) for k in range(1, 10)), F.ln(x))
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed downwards from k; 1 where k is at or above the mean.

    Below the mean terms fall off within a few standard deviations, so twelve of them (and 60 terms) are summed;
    what is left out is below 1e-30 of the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
           + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p)) + 60).cast("int")
    down = F.sequence(F.lit(0), terms)
    ratio = F.aggregate(
        down, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) * F.lit(1 - p) / ((n - k + i + 1) * F.lit(p))).alias("term"),
            (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"])
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * ratio)


def safe_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum with a cutoff (or null) for each rule.

    ``stats``: doc, stratum, two hashes of the text and the counts; ``labels``: doc_id, quality (1 good, 0 bad,
    others ignored). Copies are no independent trials: a text counts once in a stratum, however many rows and
    labels it has, and a text labelled both ways counts as neither.
    """
    known = labels.select(F.col("doc_id").alias("label_doc"), "quality").where(F.col("quality").isin(0, 1))
    held = stats.join(known, F.col("doc") == F.col("label_doc")).where(~_base_failed(F.col))
    held = held.groupBy("stratum", "h1", "h2", *STATS).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where(
        F.col("quality") == F.col("other"))
    values = _features(F.col)
    cells = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"), (values[rule] > cut).alias("hit"))
        for rule, cuts in GRID.items() for step, cut in enumerate(cuts)])
    counted = held.select("stratum", "quality", F.inline(cells)).groupBy("stratum", "rule", "step", "cutoff").agg(
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if((F.col("quality") == 1) & F.col("hit")).alias("good_hit"),
        F.count_if(F.col("quality") == 0).alias("bad"),
        F.count_if((F.col("quality") == 0) & F.col("hit")).alias("bad_hit"))
    counted = stored(counted, "rule-counts")
    strata = counted.select("stratum").distinct().count()
    tested = counted.withColumn("p", binomial_tail(F.col("good_hit"), F.col("good"), risk))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    safe = tested.withColumn("worst", F.max("p").over(walk)).where(
        F.col("worst") <= level / max(1, strata * len(GRID)))
    gain = F.when(F.col("bad") > 0, F.col("bad_hit") / F.col("bad")).otherwise(0.0) - F.col("good_hit") / F.col("good")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")
    chosen = safe.withColumn("gain", gain).where(F.col("gain") > 0).withColumn(
        "at", F.row_number().over(best)).where(F.col("at") == 1)
    return chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in GRID])


def _verdict(s, cut) -> Column:
    """True if the base and every rule that is on accept the document."""
    kept = ~_base_failed(s)
    for rule, value in _features(s).items():
        kept = kept & ~F.coalesce(value > cut(f"cut_{rule}"), F.lit(False))
    return kept


def rule_report(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, doc_id: str = "doc_id",
                text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, counts, base_failed, kept, stratum and cutoffs): one row per document.

    A null text has no words and fails the base; a null stratum is a stratum of its own; without labels (or
    too few for the level) all rules are off. Repeated rows count each; extra columns are ignored.
    """
    stats = stored(_stats(docs, doc_id, text, stratum), "text-stats")
    cuts = stored(safe_cutoffs(stats, labels, risk, level), "cutoffs").withColumnRenamed("stratum", "cut_stratum")
    joined = stats.join(broadcast_if_small(cuts, cuts.count()), same(F.col("stratum"), F.col("cut_stratum")), "left")
    return joined.select(
        F.col("doc").alias("doc_id"), *STATS[:5], _base_failed(F.col).alias("base_failed"),
        _verdict(F.col, F.col).alias("kept"), "stratum", *[f"cut_{rule}" for rule in GRID])


def _stats(docs: DataFrame, doc_id: str, text: str, stratum: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc"), F.col(stratum).alias("stratum"), F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), F.col(text)).alias("h2"), text_stats(F.col(text)).alias("s"),
    ).select("doc", "stratum", "h1", "h2", "s.*")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, doc_id: str = "doc_id",
              text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` (all columns) without the documents that the base or a rule rejects.

    Documents are written once with their counts, so that both passes read them.
    """
    body = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[stratum].alias("stratum"),
                       docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("h1"), F.xxhash64(F.lit(1), docs[text]).alias("h2"),
                       text_stats(docs[text]).alias("s"))
    counted = stored(body, "counted-texts")
    stats = counted.select(F.col("id").alias("doc"), "stratum", "h1", "h2", "s.*")
    cuts = stored(safe_cutoffs(stats, labels, risk, level), "cutoffs").select(
        F.struct("*").alias("cutoffs"), F.col("stratum").alias("cut_stratum"))
    joined = counted.join(broadcast_if_small(cuts, cuts.count()), same(F.col("stratum"), F.col("cut_stratum")), "left")
    kept = _verdict(lambda n: F.col("s")[n], lambda n: F.col("cutoffs")[n])
    return joined.where(kept).select("doc.*")
