"""Text augmentation over all documents, with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.operators import augment
from pairwright.workload import tables as t
from pairwright.workload.registry import query

EDGE = r"'^\s+|\s+$', '', 'g'"


def bind(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def draw(choice: str, at: str = "0") -> str:
    return f"md5(concat_ws('|', r, '{choice}', ({at})::VARCHAR))"


def number(choice: str, at: str = "0") -> str:
    return f"('0x' || substr({draw(choice, at)}, 1, 8))::BIGINT"


def chance(choice: str, share: float, at: str = "0") -> str:
    return f"({number(choice, at)} < {int(share * 2**32)})"


def least(places: str, count: str, choice: str) -> str:
    drawn = f"list_transform({places}, lambda p: {{'d': {draw(choice, 'p')}, 'i': p}})"
    return f"list_transform(list_sort({drawn})[1:{count}], lambda d: d.i)"


def places(words: str = "w", beyond: int = 0) -> str:
    return f"range(0, len({words}) + {beyond})"


CHANGES = f"greatest(1, floor(len(w) * {fv.WORD_CHANGE_SHARE})::INT)"
TABLE = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in fv.SYNONYMS.items()) + "}"
FILLERS = str(list(fv.FILLER_WORDS))


def word_edit(changed: str) -> str:
    return bind(rf"regexp_split_to_array(regexp_replace(t, {EDGE}), '\s+')", "w",
                f"CASE WHEN len(w) >= {fv.MIN_WORDS} THEN coalesce(array_to_string({changed}, ' '), t) ELSE t END")


def pick(options: str, choice: str, at: str) -> str:
    return bind(options, "o", f"o[{number(choice, at)} % len(o) + 1]")


def synonyms() -> str:
    other = pick(f"{TABLE}[lower(x)]", "synonym-word", "i - 1")
    capital = bind(other, "n", "CASE WHEN regexp_matches(x, '^[A-Z]') THEN upper(n[1]) || n[2:] ELSE n END")
    spots = f"list_filter({places()}, lambda p: map_contains({TABLE}, lower(w[p + 1])))"
    return word_edit(bind(least(spots, CHANGES, "synonym"), "c", "CASE WHEN len(c) > 0 THEN list_transform(w, lambda x, i: "
                          f"CASE WHEN list_contains(c, i - 1) THEN {capital} ELSE x END) END"))


def fillers() -> str:
    filler = pick(FILLERS, "filler", "q")
    return word_edit(bind(least(places(beyond=1), CHANGES, "insert"), "c", (
        f"list_filter(flatten(list_transform({places(beyond=1)}, lambda q: [CASE WHEN list_contains(c, q) THEN {filler} END, w[q + 1]])), "
        "lambda x: x IS NOT NULL)")))


def swaps() -> str:
    firsts = f"list_filter(range(0, len(w) - 1), lambda p: p % 2 = {number('swap-shift')} % 2)"
    return word_edit(bind(least(firsts, CHANGES, "swap"), "c", (
        "list_transform(w, lambda x, i: CASE WHEN list_contains(c, i - 1) THEN w[i + 1] WHEN list_contains(c, i - 2) THEN w[i - 1] ELSE x END)")))


def deletions() -> str:
    kept = f"list_filter({places()}, lambda p: NOT {chance('delete', fv.WORD_CHANGE_SHARE, 'p')})"
    few = f"list_sort({least(places(), str(fv.MIN_WORDS), 'keep')})"
    return word_edit(bind(kept, "k", f"list_transform(CASE WHEN len(k) >= {fv.MIN_WORDS} THEN k ELSE {few} END, lambda p: w[p + 1])"))


def masks() -> str:
    pattern = augment.ANY_SKILL.replace("'", "''")
    count = f"greatest(1, floor(len(f) * {fv.MASK_SHARE})::INT)"
    rebuilt = bind(least(places("f"), count, "mask"), "c", (
        "g[1] || array_to_string(list_transform(f, lambda m, i: "
        f"CASE WHEN list_contains(c, i - 1) THEN '{fv.MASK_TOKEN}' ELSE m END || g[i + 1]), '')"))
    return bind(f"regexp_extract_all(t, '{pattern}', 0)", "f", "CASE WHEN len(f) > 0 THEN "
                + bind(f"string_split_regex(t, '{pattern}')", "g", rebuilt) + " ELSE t END")


def listings() -> str:
    whole, listed = (f"regexp_extract(t, '{augment.LISTING}', {i})" for i in (0, 1))
    items = rf"list_transform(string_split({listed}, ','), lambda x: regexp_replace(x, {EDGE}))"
    drawn = f"list_sort(list_transform(l, lambda x, i: {{'d': {draw('shuffle', 'i - 1')}, 'x': x}}))"
    at = f"instr(t, {whole})"
    return (f"CASE WHEN {whole} <> '' THEN " + bind(items, "l", (
        f"CASE WHEN len(l) >= 2 THEN t[1:{at} + length({whole}) - length({listed}) - 1] || "
        f"array_to_string(list_transform({drawn}, lambda d: d.x), ', ') || substr(t, {at} + length({whole})) ELSE t END")) + " ELSE t END")


def sections() -> str:
    heads = rf"list_filter(range(0, len(l)), lambda p: regexp_matches(regexp_replace(l[p + 1], {EDGE}), '{augment.ANY_HEADER}'))"
    starts = f"list_sort(list_distinct(list_concat([0], {heads})))"
    n = number("section")
    at = f"(CASE WHEN len(s) > 2 THEN {n} % (len(s) - 1) + 1 ELSE {n} % 2 END)"
    cut = bind(at, "a", "array_to_string(list_filter(l, lambda x, i: i - 1 < s[a + 1] OR i - 1 >= coalesce(s[a + 2], len(l))), chr(10))")
    return bind("string_split(t, chr(10))", "l", bind(starts, "s", f"CASE WHEN len(s) > 1 THEN {cut} ELSE t END"))


def maybe(share: float, edit: str, choice: str) -> str:
    return f"CASE WHEN {chance(choice, share)} THEN {edit} ELSE t END"


def edited(operation: str, *edits: str, copies: int = 1) -> str:
    """Each edit in a step of its own, reading ``t`` and the row name ``r``."""
    steps = [
        f"s0 AS (SELECT doc_id, copy::INT AS copy, concat_ws('|', doc_id::VARCHAR, '{operation}', copy::VARCHAR, '42') AS r, "
        f"regexp_replace(text, '{t.NON_ASCII}', '~', 'g') AS t FROM documents, range(1, {copies + 1}) AS c(copy))"
    ]
    steps += [f"s{i} AS (SELECT doc_id, copy, r, {edit} AS t FROM s{i - 1})" for i, edit in enumerate(edits, 1)]
    return f"WITH {', '.join(steps)} SELECT doc_id, copy, length(t) AS n, md5(t) AS text_hash FROM s{len(edits)}"


WORD_EDITS = [maybe(fv.EDA_OPERATION_SHARE, edit, f"maybe-{name}") for name, edit in (
    ("synonym", synonyms()), ("insert", fillers()), ("swap", swaps()), ("delete", deletions()))]
ALL_EDITS = [
    maybe(fv.SECTION_DROP_SHARE, sections(), "maybe-section"), maybe(fv.MASK_SHARE, masks(), "maybe-mask"),
    maybe(fv.SHUFFLE_SHARE, listings(), "maybe-shuffle"), *WORD_EDITS,
]


def register(name, make, sql):
    @query(name, sql)
    def _(spark, sf):
        docs = t.documents(spark, sf).select("doc_id", "text")
        return make(docs).select("doc_id", "copy", F.length("augmented").cast("bigint").alias("n"), F.md5("augmented").alias("text_hash"))


register("aug_synonym", augment.aug_synonym, edited("synonym", synonyms()))
register("aug_insert", augment.aug_insert, edited("insert", fillers()))
register("aug_swap", augment.aug_swap, edited("swap", swaps()))
register("aug_delete", augment.aug_delete, edited("delete", deletions()))
register("aug_eda", lambda docs: augment.aug_eda(docs, num_augmentations=2), edited("words", *WORD_EDITS, copies=2))
register("aug_mask_skills", augment.aug_mask_skills, edited("mask", masks()))
register("aug_shuffle_skills", augment.aug_shuffle_skills, edited("shuffle", listings()))
register("aug_drop_section", augment.aug_drop_section, edited("section", ALL_EDITS[0]))
register("augment_texts", augment.augment_texts, edited("all", *ALL_EDITS))
# A row that its chance leaves out keeps its text through every step.
register("augment_batch", augment.augment_batch, edited("batch", *[
    f"CASE WHEN {chance('maybe-row', fv.ROW_SHARE)} THEN {edit} ELSE t END" for edit in ALL_EDITS]))


PATTERNS = ", ".join(f"'(?i){p}'" for p in fv.MASKABLE_SKILL_PATTERNS)


@query("skill_spans", rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '{t.NON_ASCII}', '~', 'g') || ' Python, ' || source || ' aws Go-Java' AS t FROM documents),
  m AS (SELECT doc_id, regexp_extract_all(t, p, 0) AS f, string_split_regex(t, p) AS g
        FROM d, (SELECT unnest([{PATTERNS}]) AS p)),
  s AS (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM m)
  SELECT doc_id, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::INT AS start_pos,
         (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i], lambda x: length(x))), 0))::INT AS end_pos, f[i] AS skill FROM s""")
def _(spark, sf):
    """All documents, each with a few skill words and its source at its end."""
    docs = t.table(spark, sf, "documents").select(
        "doc_id", F.concat(t.ascii_text(), F.lit(" Python, "), F.col("source"), F.lit(" aws Go-Java")).alias("text"))
    return augment.skill_spans(docs)
