"""Line dedup by distinct-site spread: mergeable HyperLogLog sketches, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import broadcast_if_small, same, stored, text_of

MIN_SITES = 10
#: Lines of more words than this say the same by chance nowhere; a few sites show that they are a template or passage.
LONG_WORDS = 50
LONG_SITES = 5
#: log2 of the sketch's registers; the relative error of an estimate is about 1.6 %.
SKETCH_BITS = 12
#: Estimates within this share of the threshold (six standard errors) are counted exactly.
NEAR = 0.1


def _has_word(line: Column) -> Column:
    return line.rlike(r"\S")


def _line_hashes(line: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they tell lines apart at any corpus size."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _needed(line: Column, min_sites: int, long_sites: int) -> Column:
    """The sites at which a line is boilerplate; a line of n words has 2 n - 1 characters at least."""
    long = (F.length(line) > 2 * LONG_WORDS) & (F.regexp_count(line, F.lit(r"\S+")) > LONG_WORDS)
    return F.when(long, min(min_sites, long_sites)).otherwise(min_sites).alias("needed")


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text",
                      site: str = "source", long_sites: int = LONG_SITES) -> tuple[DataFrame, DataFrame]:
    """(boilerplate, occurrences): hashes of lines on enough sites, and where frequent lines stand.

    Enough are ``min_sites``, and for lines of more than ``LONG_WORDS`` words ``long_sites`` if that is less.
    boilerplate: h1, h2, needed, estimate, first_doc. occurrences: doc, h1, h2.
    """
    lines = docs.select(
        F.col(doc_id).alias("doc"), F.col(site).alias("site"), F.explode(F.split(text_of(F.col(text)), "\n")).alias("line"),
    ).where(_has_word(F.col("line")))
    hashed = lines.select("doc", "site", *_line_hashes(F.col("line")), _needed(F.col("line"), min_sites, long_sites))
    # A line on n sites occurs n times at least, so rarer lines need no sketch.
    frequent = stored(
        hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed"))
        .where(F.col("n") >= F.col("needed")).select("h1", "h2", "needed"), "frequent-lines")
    placed = stored(
        hashed.join(broadcast_if_small(frequent, frequent.count()), ["h1", "h2", "needed"], "left_semi")
        .groupBy("h1", "h2", "needed", "site", "doc").agg(F.lit(1).alias("one")).drop("one"), "line-places")
    spread = stored(
        placed.groupBy("h1", "h2", "needed").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate"),
            F.min("doc").alias("first_doc")), "line-spread")
    near = F.abs(F.col("estimate") - F.col("needed")) <= F.greatest(NEAR * F.col("needed"), F.lit(1.0))
    close = spread.where(near).select("h1", "h2")
    counted = (
        placed.join(close, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "needed", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "needed").agg(F.count("site").alias("sites")).where(F.col("sites") >= F.col("needed"))
    )
    sure = spread.where(~near & (F.col("estimate") > F.col("needed")))
    exact = spread.join(counted.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return sure.unionByName(exact), placed.select("doc", "h1", "h2")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text",
                       site: str = "source", counted: str | None = None, long_sites: int = LONG_SITES) -> DataFrame:
    """``docs`` with the lines removed that stand on ``min_sites`` or more distinct sites, if long on ``long_sites``.

    Lines are cut at ``\\n`` and compared as they are; blank lines are never removed. The document with
    the lowest id keeps its copies of a boilerplate line, so no text leaves the corpus altogether. A
    null site counts as none, a null text stays null, a document left without lines has an empty text.
    Rows with one id are treated alike; a null id is an id and sorts last. All other columns stay as they are;
    ``counted`` names a further column for the number of removed lines.
    """
    boilerplate, places = boilerplate_lines(docs, min_sites, doc_id, text, site, long_sites)
    drop = (
        places.join(boilerplate.select("h1", "h2", "first_doc"), ["h1", "h2"])
        .where(~same(F.col("doc"), F.col("first_doc")))
        .groupBy(F.col("doc").alias("_drop_doc"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_drop_lines"))
    )
    joined = docs.join(drop, same(docs[doc_id], drop["_drop_doc"]), "left")
    lines = F.split(docs[text], "\n")
    kept = F.filter(lines, lambda line: ~_has_word(line) | ~F.array_contains(
        drop["_drop_lines"], F.struct(*_line_hashes(line))))
    touched = drop["_drop_lines"].isNotNull()
    columns = [
        F.when(touched, F.array_join(kept, "\n")).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns
    ]
    if counted:
        columns.append(F.when(touched & docs[text].isNotNull(), F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias(counted))
    return joined.select(*columns)
