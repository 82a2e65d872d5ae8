"""Personal data by patterns, and by bootstrapped contextual extraction.

Base kinds are found with expressions. Their spans are the seeds of a bootstrap over lexical contexts: each
mention (a seed, or another identifier-like run of tokens) stands between words, and a pattern is what stands left
of it (two words) or around it (one word on either side). Words are runs of letters and digits of the whole text,
other mentions included, lower-cased, digits as 0, so seeds and candidates meet in the same patterns.
Spark scores the pattern-instance graph in rounds: a pattern's score for a kind is the mean score of its distinct
instances, damped for few instances; an instance's score is the chance that one of its patterns is right; seeds
stay at 1. Patterns that end at ``CONFIDENT`` or above give their kind to candidates of a fitting shape that no
seed covers.

A candidate is a maximal run of tokens (with a digit or an at sign) joined by single blanks, between which brackets,
hyphens or slashes may stand, so that spaced identifiers are whole. Its tokens are candidates too where the run
has no kind's shape, or the token has one itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import let, stored, text_of
from pairwright.operators.skew import salted_join

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base expressions, anchored where only the leftmost match can begin, so that no
#: text makes them backtrack or start again at each character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Token: a run without blanks that holds a digit or an at sign.
TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"
#: Tokens joined by single blanks; a token that ends in other signs (a full stop, say) ends the run.
RUN = rf"(?<!\S){TOKEN}(?:(?<=[0-9A-Za-z()/-])\x20(?:[()/-]++\x20)?+{TOKEN})*+"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What a discovered token of a kind has to look like.
SHAPES = {
    "email": r"^\S{2,}@\S{2,}$",
    "ip": r"^[^0-9A-Za-z]*(?:[0-9]{1,3}[.:_-]){3}[0-9]{1,3}[^0-9A-Za-z]*$",
    "card": r"^(?:[^0-9A-Za-z]*[0-9]){12,19}[^0-9A-Za-z]*$",
    "phone": r"^(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*$",
}
ROUNDS = 3
CONFIDENT = 0.8
DAMPING = 1.0
CONTEXT = 60


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit is doubled."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Running sums of an array, by doubling: n log n steps, however many entries."""
    rounds = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)).cast("double"))).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), rounds), lengths,
        lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(
            F.get(sums, i - F.pow(F.lit(2), k - 1).cast("int")), F.lit(0))))


def _words(piece: Column) -> Column:
    """Words of a short piece, lower-cased, digits as 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(piece), "[0-9]", "0"), r"[^\p{L}\p{N}]++", " ")
    return F.array_remove(F.split(plain, " "), "")


def _before(piece: Column) -> Column:
    """The last two words of what stands left."""
    return let(_words(F.right(piece, F.lit(CONTEXT))), lambda words: F.array_join(
        F.slice(words, -F.least(F.greatest(F.size(words), F.lit(1)), F.lit(2)), 2), " "))


def _after(piece: Column) -> Column:
    return F.coalesce(F.get(_words(F.left(piece, F.lit(CONTEXT))), F.lit(0)), F.lit(""))


def _spans(text: Column, pattern: str, kind: Column) -> Column:
    """Structs (kind, start, end, value, before, after) of the non-overlapping matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")

    def placed(found: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

            def left(i: Column) -> Column:  # a piece may be a mere blank, so the matches left of it count too
                return F.concat_ws("", *[x for back in (2, 1) for x in (
                    F.right(F.get(pieces, i - back), F.lit(CONTEXT)), F.right(F.get(found, i - back), F.lit(CONTEXT)))], F.get(pieces, i))

            def right(i: Column) -> Column:
                return F.concat_ws("", F.get(pieces, i + 1), F.left(F.get(found, i + 1), F.lit(CONTEXT)))

            return let(_running(lengths), lambda ends: F.transform(found, lambda m, i: F.struct(
                kind.alias("kind"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"),
                _before(left(i)).alias("before"), _after(right(i)).alias("after"))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_pieces)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _any_shape(value: Column) -> Column:
    fits = F.lit(False)
    for shape in SHAPES.values():
        fits = fits | value.rlike(shape)
    return fits


def _tokens(run: Column) -> Column:
    """The tokens of a run of several that are candidates of their own."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")

    def cut(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            def token(part: Column, i: Column) -> Column:
                left = F.concat_ws(" ", run["before"], F.get(parts, i - 2), F.get(parts, i - 1))
                end = run["start"] + F.get(ends, i) - 1
                return F.struct(
                    F.lit(None).cast("string").alias("kind"), (end - F.length(part)).alias("start"), end.alias("end"),
                    part.alias("value"), _before(left).alias("before"),
                    _after(F.concat_ws(" ", F.get(parts, i + 1), run["after"])).alias("after"))

            return F.transform(parts, token)

        whole = _any_shape(run["value"])
        own = let(_running(F.transform(parts, lambda p: F.length(p) + 1)), placed)
        return F.when(F.size(parts) > 1, F.filter(own, lambda t: t["value"].rlike("[0-9@]") & (
            ~whole | _any_shape(t["value"])))).otherwise(none)

    return let(F.split(run["value"], " "), cut)


def candidates(text: Column) -> Column:
    """Runs of tokens and the tokens that count alone, as spans without a kind."""
    runs = _spans(text, RUN, F.lit(None).cast("string"))
    return let(runs, lambda found: F.concat(
        F.filter(found, lambda r: ~r["value"].contains(" ") | _any_shape(r["value"])), F.flatten(F.transform(found, _tokens))))


def base_spans(text: Column) -> Column:
    """The valid base spans of a text, by kind and start."""
    return F.flatten(F.array(*[_checked(text, kind) for kind in KINDS]))


def _checked(text: Column, kind: str) -> Column:
    return F.filter(_spans(text, PATTERNS[kind], F.lit(kind)), lambda s: _valid(kind, s["value"]))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")


def _mentions(spans: DataFrame) -> DataFrame:
    """(digest, kind, start, end, value, before, after): seeds, and tokens (kind null) that no seed overlaps."""
    rows = spans.select("digest", F.inline(F.concat("base", "tokens")))
    ordered = Window.partitionBy("digest").orderBy("start", "end")
    seed = F.col("kind").isNotNull()
    marked = rows.withColumn("reached", F.max(F.when(seed, F.col("end"))).over(
        ordered.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.min(F.when(seed, F.col("start"))).over(
            ordered.rowsBetween(1, Window.unboundedFollowing)))
    free = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return marked.where(seed | free).drop("reached", "next")


def _confident_patterns(edges: DataFrame, rounds: int, confident: float, least: int) -> DataFrame:
    """(pattern, kind): edges (pattern, instance, kind or null) scored in rounds."""
    graph = stored(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    seeds = graph.where(F.col("kind").isNotNull()).select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    seeds = stored(seeds, "seeds")
    sizes = stored(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "pattern-sizes")
    links = stored(graph.join(sizes, "pattern").select("pattern", "instance", "n"), "links")
    scores, patterns = seeds, None
    for _ in range(rounds):
        sums = links.join(scores, "instance").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("sum"))
        patterns = stored(sums.select("pattern", "kind", (F.col("sum") / (F.col("n") + DAMPING)).alias("score")), "pattern-scores")
        likely = patterns.where(F.col("score") >= 0.5).withColumnRenamed("score", "right")
        reached = links.select("pattern", "instance").join(likely, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("right"), F.lit(1e-6)))))).alias("score"))
        scores = stored(
            seeds.unionByName(reached.select("instance", "kind", "score")).groupBy("instance", "kind").agg(
                F.max("score").alias("score")), "instance-scores")
    return patterns.where(F.col("score") >= confident).select("pattern", "kind")


def _patterns() -> Column:
    """The two patterns of a mention; a blank context makes none."""
    left = F.get(F.split("before", " "), F.size(F.split("before", " ")) - 1)
    two = F.when(F.size(F.split("before", " ")) == 2, F.concat(F.lit("l:"), "before"))
    around = F.when((left != "") & (F.col("after") != ""), F.concat(F.lit("a:"), left, F.lit(" _ "), "after"))
    return F.array_compact(F.array(two, around))


def _trimmed(found: DataFrame) -> DataFrame:
    """Spans without the signs around them; a leading plus or bracket stays."""
    lead = F.length(F.regexp_extract("value", r"^[^0-9A-Za-z(+]*+", 0))
    trail = F.length(F.regexp_extract("value", r"(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", 0))
    return found.withColumns({"start": F.col("start") + lead, "end": F.col("end") - trail})


def _discovered(mentions: DataFrame, sure: DataFrame) -> DataFrame:
    """(digest, more): the spans that confident patterns give a kind, none within another.

    Where patterns give a span several kinds, the first in the order of ``KINDS`` holds.
    """
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    shaped = F.lit(False)
    for kind in KINDS:
        shaped = shaped | ((F.col("found") == kind) & F.col("value").rlike(SHAPES[kind]))
    given = (
        mentions.where(F.col("kind").isNull()).select("digest", "start", "end", "value", F.explode("patterns").alias("pattern"))
        .join(sure.withColumnRenamed("kind", "found"), "pattern").where(shaped)
        .groupBy("digest", "start", "end", "value").agg(F.min_by("found", place[F.col("found")]).alias("kind"))
    )
    ordered = Window.partitionBy("digest").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = given.withColumn("reached", F.coalesce(F.max("end").over(ordered), F.lit(0))).where(F.col("start") >= F.col("reached"))
    return _trimmed(outer).groupBy("digest").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, least: int = 5,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row per document.

    Counts and the hash are those of the base spans; ``spans`` lists base and discovered spans as
    kind:start:end, by kind and start. Null and empty texts have no spans. Equal texts get equal results and
    count once as evidence; repeated rows and null ids are reported each; extra columns are ignored; an
    empty table gives no rows. A pattern needs ``least`` distinct instances. A span is given one kind, and of
    two discovered spans within each other the longer counts.
    """
    body = text_of(F.col(text))
    found = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.md5(body).alias("digest"), base_spans(body).alias("base"),
        candidates(body).alias("tokens")), "spans")
    texts = found.groupBy("digest").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
    mentions = stored(
        _mentions(texts).withColumn("instance", F.xxhash64(F.lower("value"))).withColumn("patterns", _patterns()), "mentions")
    edges = mentions.select("instance", "kind", F.explode("patterns").alias("pattern"))
    sure = stored(_confident_patterns(edges, rounds, confident, least), "sure-patterns")
    fresh = stored(_discovered(mentions, sure), "discovered")
    own = found.select("doc_id", "digest", F.transform("base", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    # one text may stand in a third of all rows
    joined = salted_join(own, fresh, ["digest"], "left", spread_by=["doc_id"])

    def listed(spans: Column) -> Column:
        place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
            place[s["kind"]].alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.select(
        "doc_id", *[_count("base", kind) for kind in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", F.coalesce("more", none))).alias("spans"))
