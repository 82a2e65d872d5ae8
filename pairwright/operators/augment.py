"""Text augmentation as expressions, reproducible per (document, operation, copy).

Every choice is drawn from ``md5(row | choice | position)``: the places with the smallest draws are changed, and
a draw's leading digits pick among options or decide a chance. So a text depends on its row alone, whatever
the engine, the partitioning or the number of retries, and no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.text import let, match_spans

#: (text, row name) -> changed text
Edit = Callable[[Column, Column], Column]

ANY_SKILL = "(?i)" + "|".join(fv.MASKABLE_SKILL_PATTERNS)
LISTING = "(?i)" + fv.SKILL_LISTING_PATTERN
ANY_HEADER = "(?i)" + "|".join(fv.SECTION_PATTERNS)
EDGE_BLANKS = r"^\s+|\s+$"


def _draw(row: Column, choice: str, at: Column | int = 0) -> Column:
    place = F.lit(at) if isinstance(at, int) else at
    return F.md5(F.concat_ws("|", row, F.lit(choice), place.cast("string")))


def _number(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint")


def _chance(row: Column, choice: str, share: float, at: Column | int = 0) -> Column:
    return _number(_draw(row, choice, at)) < int(share * 2**32)


def _least_drawn(places: Column, count: Column, row: Column, choice: str) -> Column:
    """The ``count`` places with the smallest draws."""
    drawn = F.array_sort(F.transform(places, lambda i: F.struct(_draw(row, choice, i).alias("d"), i.alias("i"))))
    return F.transform(F.slice(drawn, F.lit(1), count), lambda d: d["i"])


def _drawn_flags(places: Column, count: Column, row: Column, choice: str, able: Callable[[Column], Column] | None = None) -> Column:
    """For every place from 0 on whether its draw is among the ``count`` smallest of the able places.

    Each place is compared with the last draw that counts, so the work grows with the text's length alone.
    """
    def draw(i: Column) -> Column:
        own = F.struct(_draw(row, choice, i).alias("d"), i.alias("i"))
        return own if able is None else F.when(able(i), own)

    return let(F.transform(places, draw), lambda drawn: let(
        let(F.array_sort(F.array_compact(drawn)), lambda order: F.get(order, F.least(count, F.size(order)) - 1)),
        lambda last: F.transform(drawn, lambda own: F.coalesce(own <= last, F.lit(False)))))


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, EDGE_BLANKS, ""), r"\s+")


def _changes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words) * fv.WORD_CHANGE_SHARE).cast("int"))


def _places(words: Column, first: int = 0, beyond: int = 0) -> Column:
    return F.sequence(F.lit(first), F.size(words) - 1 + beyond)


def _pick(options: Column, row: Column, choice: str, at: Column) -> Column:
    return F.get(options, F.pmod(_number(_draw(row, choice, at)), F.size(options)).cast("int"))


def _word_edit(change: Callable[[Column, Column], Column], text: Column, row: Column) -> Column:
    """``change`` (words, row) -> words or null, on texts that are long enough; null keeps the text."""
    return let(_words(text), lambda words: F.when(
        F.size(words) >= fv.MIN_WORDS, F.coalesce(F.array_join(change(words, row), " "), text)).otherwise(text))


def replace_synonyms(text: Column, row: Column) -> Column:
    table = F.create_map(*[x for word, others in fv.SYNONYMS.items() for x in (
        F.lit(word), F.array(*[F.lit(o) for o in others]))])

    def change(words: Column, row: Column) -> Column:
        def replaced(chosen: Column) -> Column:
            def one(word: Column, i: Column) -> Column:
                other = _pick(F.try_element_at(table, F.lower(word)), row, "synonym-word", i)
                capital = F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 99))
                return F.when(F.get(chosen, i), F.when(word.rlike("^[A-Z]"), capital).otherwise(other)).otherwise(word)

            return F.when(F.array_contains(chosen, True), F.transform(words, one))

        known = lambda i: F.map_contains_key(table, F.lower(F.get(words, i)))
        return let(_drawn_flags(_places(words), _changes(words), row, "synonym", known), replaced)

    return _word_edit(change, text, row)


def insert_fillers(text: Column, row: Column) -> Column:
    fillers = F.array(*[F.lit(w) for w in fv.FILLER_WORDS])

    def change(words: Column, row: Column) -> Column:
        def filled(chosen: Column) -> Column:
            return F.array_compact(F.flatten(F.transform(_places(words, beyond=1), lambda i: F.array(
                F.when(F.get(chosen, i), _pick(fillers, row, "filler", i)), F.get(words, i)))))

        return let(_drawn_flags(_places(words, beyond=1), _changes(words), row, "insert"), filled)

    return _word_edit(change, text, row)


def swap_neighbours(text: Column, row: Column) -> Column:
    """Swaps within distinct pairs of neighbours, which begin at an even or at an odd place."""

    def change(words: Column, row: Column) -> Column:
        shift = F.pmod(_number(_draw(row, "swap-shift")), F.lit(2)).cast("int")
        firsts = _drawn_flags(F.sequence(F.lit(0), F.size(words) - 2), _changes(words), row, "swap", lambda i: i % 2 == shift)
        return let(firsts, lambda chosen: F.transform(
            words, lambda word, i: F.when(F.get(chosen, i), F.get(words, i + 1)).when(
                F.get(chosen, i - 1), F.get(words, i - 1)).otherwise(word)))

    return _word_edit(change, text, row)


def delete_words(text: Column, row: Column) -> Column:
    """Each word goes with its own chance; at least the minimum stays, the least drawn ones if need be."""

    def change(words: Column, row: Column) -> Column:
        kept = F.filter(_places(words), lambda i: ~_chance(row, "delete", fv.WORD_CHANGE_SHARE, i))
        few = F.array_sort(_least_drawn(_places(words), F.lit(fv.MIN_WORDS), row, "keep"))
        return let(kept, lambda k: let(F.when(F.size(k) >= fv.MIN_WORDS, k).otherwise(few), lambda stay: F.transform(
            stay, lambda i: F.get(words, i))))

    return _word_edit(change, text, row)


def mask_skills(text: Column, row: Column) -> Column:
    def masked(found: Column, pieces: Column) -> Column:
        count = F.greatest(F.lit(1), F.floor(F.size(found) * fv.MASK_SHARE).cast("int"))
        return let(_least_drawn(_places(found), count, row, "mask"), lambda chosen: F.concat(
            F.get(pieces, F.lit(0)), F.array_join(F.transform(found, lambda m, i: F.concat(
                F.when(F.array_contains(chosen, i), F.lit(fv.MASK_TOKEN)).otherwise(m), F.get(pieces, i + 1))), "")))

    return let(F.regexp_extract_all(text, F.lit(ANY_SKILL), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, ANY_SKILL, -1), lambda pieces: masked(found, pieces))).otherwise(text))


def shuffle_skill_list(text: Column, row: Column) -> Column:
    """The first comma list after a listing word, in the order of its items' draws."""
    whole, listed = F.regexp_extract(text, LISTING, 0), F.regexp_extract(text, LISTING, 1)
    items = F.transform(F.split(listed, ","), lambda item: F.regexp_replace(item, EDGE_BLANKS, ""))

    def shuffled(items: Column) -> Column:
        order = F.array_sort(F.transform(items, lambda x, i: F.struct(_draw(row, "shuffle", i).alias("d"), x.alias("x"))))
        mixed = F.array_join(F.transform(order, lambda s: s["x"]), ", ")
        at = F.instr(text, whole)
        return F.when(F.size(items) >= 2, F.concat(
            F.substring(text, F.lit(1), at + F.length(whole) - F.length(listed) - 1), mixed,
            F.substring(text, at + F.length(whole), F.length(text)))).otherwise(text)

    return F.when(whole != "", let(items, shuffled)).otherwise(text)


def remove_section(text: Column, row: Column) -> Column:
    """Without one section; of three or more never the first."""

    def cut(lines: Column) -> Column:
        heads = F.filter(_places(lines), lambda i: F.regexp_replace(F.get(lines, i), EDGE_BLANKS, "").rlike(ANY_HEADER))
        starts = F.array_sort(F.array_union(F.array(F.lit(0)), heads))

        def without(starts: Column) -> Column:
            draw, count = _number(_draw(row, "section")), F.size(starts)
            at = F.when(count > 2, F.pmod(draw, count - 1) + 1).otherwise(F.pmod(draw, F.lit(2))).cast("int")
            low, high = F.get(starts, at), F.coalesce(F.get(starts, at + 1), F.size(lines))
            return F.when(count > 1, F.array_join(F.filter(lines, lambda line, i: (i < low) | (i >= high)), "\n")).otherwise(text)

        return let(starts, without)

    return let(F.split(text, "\n"), cut)


def maybe(share: float, edit: Edit, choice: str) -> Edit:
    """The edit, by chance."""
    return lambda text, row: F.when(_chance(row, choice, share), edit(text, row)).otherwise(text)


def in_turn(*edits: Edit) -> Edit:
    def run(text: Column, row: Column) -> Column:
        for edit in edits:
            text = _bound(edit, text, row)
        return text

    return run


def _bound(edit: Edit, text: Column, row: Column) -> Column:
    return let(text, lambda t: edit(t, row))


edit_words = in_turn(*[maybe(fv.EDA_OPERATION_SHARE, edit, f"maybe-{name}") for name, edit in (
    ("synonym", replace_synonyms), ("insert", insert_fillers), ("swap", swap_neighbours), ("delete", delete_words))])
edit_skills = in_turn(maybe(fv.MASK_SHARE, mask_skills, "maybe-mask"), maybe(fv.SHUFFLE_SHARE, shuffle_skill_list, "maybe-shuffle"))
#: Sections, then skills, then words.
edit_all = in_turn(maybe(fv.SECTION_DROP_SHARE, remove_section, "maybe-section"), edit_skills, edit_words)


def rewrite(df: DataFrame, edit: Edit, operation: str, key: str = "doc_id", text: str = "text",
            copies: int = 1, seed: int = 42, name: str = "augmented") -> DataFrame:
    """Apply a text edit ``copies`` times per row; adds ``copy`` and ``augmented``. A null text stays null."""
    spread = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    row = F.concat_ws("|", F.col(key).cast("string"), F.lit(operation), F.col("copy").cast("string"), F.lit(str(seed)))
    edited = let(row, lambda r: let(F.col(text), lambda t: edit(t, r)))
    return spread.withColumn(name, F.when(F.col(text).isNotNull(), edited))


def aug_synonym(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, replace_synonyms, "synonym", **options)


def aug_insert(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, insert_fillers, "insert", **options)


def aug_swap(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, swap_neighbours, "swap", **options)


def aug_delete(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, delete_words, "delete", **options)


def aug_eda(df: DataFrame, num_augmentations: int = 1, **options) -> DataFrame:
    return rewrite(df, edit_words, "words", copies=num_augmentations, **options)


def aug_mask_skills(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, mask_skills, "mask", **options)


def aug_shuffle_skills(df: DataFrame, **options) -> DataFrame:
    return rewrite(df, shuffle_skill_list, "shuffle", **options)


def aug_drop_section(df: DataFrame, share: float = fv.SECTION_DROP_SHARE, **options) -> DataFrame:
    return rewrite(df, maybe(share, remove_section, "maybe-section"), "section", **options)


def augment_texts(df: DataFrame, **options) -> DataFrame:
    """Every kind of edit on every row."""
    return rewrite(df, edit_all, "all", **options)


def augment_batch(df: DataFrame, share: float = fv.ROW_SHARE, **options) -> DataFrame:
    """Every kind of edit, on a seeded share of the rows; the others stay as they are."""
    return rewrite(df, maybe(share, edit_all, "maybe-row"), "batch", **options)


def skill_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per maskable skill mention: ``key, start_pos, end_pos, skill``, by start within a text."""
    found = F.flatten(F.array(*[match_spans(F.col(text), "(?i)" + p) for p in fv.MASKABLE_SKILL_PATTERNS]))
    return df.where(F.col(text).isNotNull()).select(key, F.inline(F.array_sort(found)).alias("start_pos", "end_pos", "skill"))
