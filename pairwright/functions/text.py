"""Parsing and normalising of text-valued columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import fixed_values as fv


def blank_to_null(value: Column) -> Column:
    """'' counts as missing wherever a text falls back to another one."""
    return F.nullif(value, F.lit(""))


def _without_braces(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"^\{([\s\S]*)\}$", "$1")


def parse_skills(value: Column) -> Column:
    """``{a,"b c"}`` or ``a, b`` to a list without empty items; null to an empty list."""
    items = F.filter(
        F.transform(F.split(_without_braces(value), ","), lambda item: F.trim(item)), lambda item: item != ""
    )
    unquoted = F.transform(
        items, lambda item: F.regexp_replace(F.regexp_replace(item, '^"+|"+$', ""), "^'+|'+$", "")
    )
    return F.coalesce(unquoted, F.array().cast("array<string>"))


def parse_skills_schema(value: Column) -> Column:
    """The response variant: strips only double quotes and keeps empty items."""
    items = F.transform(
        F.split(_without_braces(value), ","),
        lambda item: F.regexp_replace(F.trim(item), '^"+|"+$', ""),
    )
    return F.coalesce(items, F.array().cast("array<string>"))


def location_label(city: Column, country: Column) -> Column:
    """``city, country``; null when either part is null."""
    return F.concat(city, F.lit(", "), country)


def uuid_valid(value: Column) -> Column:
    return F.coalesce(value.rlike(fv.UUID_PATTERN), F.lit(False))


def keywords_to_phrase(keywords: Column) -> Column:
    """All keywords joined to one phrase."""
    return F.array_join(keywords, " ")


def search_tokens(keywords: Column) -> Column:
    """Lower-cased words of every keyword, in order."""
    return F.flatten(F.transform(keywords, lambda word: F.split(F.lower(word), " ")))


def clean_location_filters(locations: Column) -> Column:
    """Drop blank strings; without a city there are no coordinates either."""

    def cleaned(loc: Column) -> Column:
        city = F.when(F.trim(loc["city"]) != "", loc["city"])
        return F.struct(
            F.when(F.trim(loc["country"]) != "", loc["country"]).alias("country"),
            city.alias("city"),
            F.when(city.isNotNull(), loc["latitude"]).alias("latitude"),
            F.when(city.isNotNull(), loc["longitude"]).alias("longitude"),
            loc["radius_km"].alias("radius_km"),
        )

    return F.transform(locations, cleaned)


def match_request_key(
    positional: Sequence[Column],
    named: dict[str, Column],
    applied_ids: Column | None = None,
    cooled_ids: Column | None = None,
) -> Column:
    """One canonical text per request: equal requests get equal keys.

    ``named`` values must already be text; lists are rendered by ``sorted_list_text``.
    """
    parts = [part.cast("string") for part in positional]
    for name in sorted(named):
        parts.append(F.concat(F.lit(f"{name}_"), named[name].cast("string")))
    for name, ids in (("applied", applied_ids), ("cooled", cooled_ids)):
        if ids is not None:
            joined = F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ",")
            parts.append(F.concat(F.lit(f"{name}_ids_hash_"), F.sha2(joined, 256)))
    key = F.concat_ws("_", *parts)
    return F.when(F.length(key) > 250, F.sha2(key, 256)).otherwise(key)


def sorted_list_text(values: Column) -> Column:
    """``['a', 'b']`` with sorted items, the rendering used inside request keys."""
    quoted = F.transform(
        F.array_sort(values), lambda v: F.concat(F.lit("'"), v.cast("string"), F.lit("'"))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def extract_host(domain: Column, strip_www: bool = False) -> Column:
    """Host of a bare domain or of a full URL; '' when there is none."""
    text = F.coalesce(domain, F.lit(""))
    schemed = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("http://"), text))
    rest = F.regexp_replace(schemed, r"^[^:/?#]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.coalesce(blank_to_null(host), path)
    host = F.regexp_replace(F.trim(host), "^/+|/+$", "")
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    return F.when(text == "", F.lit("")).otherwise(host)


def safe_name(value: Column, default: str = "logo") -> Column:
    """A file-name-safe form of a text."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(blank_to_null(cleaned), F.lit(default))


def tokenize_bm25(text: Column, stopwords: Sequence[str] = fv.STOPWORDS) -> Column:
    """Lower-cased word tokens longer than one character, without stopwords."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    kept = F.filter(
        tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords) if stopwords else F.length(t) > 1
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """Running sums of an array by doubling: n log n steps, however many entries."""
    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(2)).cast("double"))).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), rounds), numbers,
        lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(
            F.get(sums, i - F.pow(F.lit(2), k - 1).cast("int")), F.lit(0))))


def match_spans(text: Column, pattern: str) -> Column:
    """Structs (start_pos, end_pos, found) of the non-overlapping matches, from 0, end exclusive."""
    none = F.array().cast("array<struct<start_pos:int,end_pos:int,found:string>>")

    def placed(found: Column, pieces: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        return let(running_sums(lengths), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start_pos"), F.get(ends, i).alias("end_pos"), m.alias("found"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces))).otherwise(none))
