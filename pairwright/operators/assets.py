"""Page images, brand search hits and image checks as table jobs."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pairwright import fixed_values as fv
from pairwright.functions.text import blank_to_null

# --- fixed values ------------------------------------------------------------------
IMAGE_TYPES = (
    "image/png", "image/jpeg", "image/gif", "image/webp", "image/svg+xml",
    "image/x-icon", "image/vnd.microsoft.icon", "image/avif", "image/heic",
)
OLDER_IMAGE_TYPES = IMAGE_TYPES[:5]
TEXT_TYPES = ("application/json", "application/xml")
MIN_IMAGE_BYTES = 64
SNIFF_BYTES = 2048
SIZE_HINT = r"(?:(?<=/w/)|(?<=/h/)|(?<=\bw=)|(?<=\bh=))(\d{2,4})"


# --- page images ---------------------------------------------------------------------
def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double, single or no quotes; null when absent or empty."""
    found = F.regexp_extract(
        tag, rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1
    )
    value = F.regexp_replace(F.regexp_replace(found, """^["']|["']$""", ""), "&amp;", "&")
    return blank_to_null(F.trim(value))


def size_hint(url: Column) -> Column:
    """Largest width or height hint in a url, else 1."""
    hints = F.regexp_extract_all(url, F.lit(SIZE_HINT), F.lit(1))
    return F.coalesce(F.array_max(F.transform(hints, lambda h: h.cast("double"))), F.lit(1.0))


def _best_of_srcset(srcset: Column) -> Column:
    """Url with the largest ``x`` or ``w`` descriptor (or size hint); the first one on ties."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")

    def scored(part: Column, at: Column) -> Column:
        words = F.split(part, r"\s+")
        url = F.get(words, F.lit(0))
        text = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
        number = F.regexp_extract(text, r"^(.*)[xw]$", 1).try_cast("double")
        score = (
            F.when(text.endswith("x"), F.coalesce(number, F.lit(1.0)))
            .when(text.endswith("w"), F.coalesce(number, size_hint(url)))
            .otherwise(size_hint(url))
        )
        return F.struct(score.alias("score"), (-at).alias("at"), url.alias("url"))

    return F.array_max(F.transform(parts, scored))["url"]


@F.pandas_udf(StringType())
def _absolute(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series(
        [None if u is None else urljoin(b or "", u) for b, u in zip(base, url)], dtype=object
    )


def page_best_image(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                    html: str = "html") -> DataFrame:
    """``page_id, image_url, source``: the page's best image, null when it has none.

    Tried in order: og:image, preloaded image, picture, the img with the largest size hint,
    the srcset of any source. Tags are found by pattern; only the winner is made absolute.
    """
    body = F.col(html)
    og = F.get(F.filter(
        _tags(body, "meta"), lambda t: _attribute(t, "property").eqNullSafe("og:image")
    ), F.lit(0))
    links = F.filter(_tags(body, "link"), lambda t: (
        F.coalesce(_attribute(t, "rel").rlike(r"(?i)\b(preload|prefetch)\b"), F.lit(False))
        & (_attribute(t, "as").eqNullSafe("image")
           | F.coalesce(_attribute(t, "imagesrcset").contains("image"), F.lit(False)))
        & _attribute(t, "href").isNotNull()
    ))
    pictures = F.regexp_extract_all(body, F.lit(r"(?is)<picture\b.*?</picture>"), F.lit(0))

    def of_picture(block: Column) -> Column:
        sets = F.array_compact(F.transform(_tags(block, "source"), lambda t: _attribute(t, "srcset")))
        first = F.get(F.array_compact(F.transform(sets, _best_of_srcset)), F.lit(0))
        return F.coalesce(first, _attribute(F.get(_tags(block, "img"), F.lit(0)), "src"))

    sources = F.array_compact(F.transform(_tags(body, "img"), lambda t: _attribute(t, "src")))
    # compared as absolute urls in the system matched; a common prefix keeps that order
    largest = F.array_max(F.transform(
        sources, lambda s: F.struct(size_hint(s).alias("size"), s.alias("url"))
    ))["url"]
    sets = F.array_compact(F.transform(_tags(body, "source"), lambda t: _attribute(t, "srcset")))
    options = F.array(*[
        F.struct(value.alias("url"), F.lit(label).alias("source"))
        for value, label in (
            (_attribute(og, "content"), "og_image"),
            (_attribute(F.get(links, F.lit(0)), "href"), "preload"),
            (F.get(F.array_compact(F.transform(pictures, of_picture)), F.lit(0)), "picture"),
            (largest, "img"),
            (F.get(F.array_compact(F.transform(sets, _best_of_srcset)), F.lit(0)), "srcset"),
        )
    ])
    best = F.get(F.filter(options, lambda o: o["url"].isNotNull()), F.lit(0))
    chosen = pages.select(page_id, url, best.alias("_best"))
    return chosen.select(
        page_id, _absolute(F.col(url), F.col("_best.url")).alias("image_url"),
        F.col("_best.source").alias("source"),
    )


# --- brand search hits -----------------------------------------------------------------
_HIT = "domain string, website string, brandId string, id string, slug string, name string"


def brand_identifier(hits: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``matched_name, identifier, error`` from the JSON body of a brand search.

    The first item counts. Its domain, website host, brandId, id and slug are tried in order;
    a value is usable when it has a dot or no slash, else the first one is taken.
    """
    text = F.trim(F.col(body))
    whole = F.when(text.startswith("["), text).otherwise(F.coalesce(
        F.get_json_object(text, "$.results"), F.get_json_object(text, "$.brands"),
        F.get_json_object(text, "$.items"),
    ))
    first = F.get(F.from_json(whole, f"array<struct<{_HIT.replace(' string', ': string')}>>"), F.lit(0))

    def filled(name: str) -> Column:
        return blank_to_null(first[name])

    host = blank_to_null(F.regexp_extract(first["website"], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    values = F.array_compact(F.array(filled("domain"), host, filled("brandId"), filled("id"), filled("slug")))
    usable = F.filter(values, lambda v: v.contains(".") | ~v.contains("/"))
    identifier = F.coalesce(F.get(usable, F.lit(0)), F.get(values, F.lit(0)))
    return hits.withColumns({
        "matched_name": first["name"],
        "identifier": identifier,
        "error": F.when(first.isNull(), "no_results").when(
            identifier.isNull(), "no_identifier_in_first_result"),
    })


# --- image checks ----------------------------------------------------------------------
def _bytes_text(sniff: Column) -> Column:
    """The first bytes as text, one character per byte."""
    return F.decode(F.substring(F.coalesce(sniff, F.to_binary(F.lit(""), F.lit("hex"))), 1, SNIFF_BYTES), "ISO-8859-1")


def _starts(sniff: Column, *hex_prefixes: str) -> Column:
    start = F.hex(F.substring(sniff, 1, 16))
    hit = F.lit(False)
    for prefix in hex_prefixes:
        hit = hit | start.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def image_bytes(sniff: Column, newer: bool = True) -> Column:
    """Whether the first bytes are those of an image."""
    head = _bytes_text(sniff)
    hit = (
        _starts(sniff, fv.PNG_BYTES, fv.JPEG_BYTES, *fv.GIF_BYTES)
        | (_starts(sniff, fv.RIFF_BYTES) & F.substring(head, 1, 16).contains(fv.WEBP_MARK))
        | F.lower(head).contains(fv.SVG_MARK)
    )
    if newer:
        brand = F.substring(head, 9, 8)
        known = F.lit(False)
        for name in fv.IMAGE_BRANDS:
            known = known | brand.contains(name)
        hit = hit | _starts(sniff, fv.ICON_BYTES) | (
            (F.length(head) >= 16) & (F.substring(head, 5, 4) == fv.BRAND_MARK) & known
        )
    return F.coalesce(hit, F.lit(False))


def _plain_type(content_type: Column) -> Column:
    return F.trim(F.get(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";"), F.lit(0)))


def asset_validity(
    assets: DataFrame, content_type: str = "content_type", sniff: str = "sniff",
    length: str = "content_length", strict: bool = False,
) -> DataFrame:
    """Adds ``is_image`` and ``reason`` from type, first bytes and length; first rule wins."""
    ct, data = _plain_type(F.col(content_type)), F.col(sniff)
    size = F.coalesce(F.length(data), F.lit(0))
    head = F.lower(F.ltrim(_bytes_text(data)))
    html = (
        head.startswith("<!doctype html") | head.contains("<html") | head.contains("<head")
        | head.contains("<body")
    )
    promised = (size == 0) & (F.coalesce(F.col(length), F.lit(0)) > 0) & F.lit(not strict)
    long_enough = (F.coalesce(F.col(length), F.lit(0)) > 0) & F.lit(not strict)
    texty = ct.startswith("text/") | ct.isin(*TEXT_TYPES)
    unknown = (ct == "") | (ct == "application/octet-stream")
    shown = F.when(ct == "", F.lit(fv.REASON_MISSING_TYPE)).otherwise(ct)
    rules = [
        (image_bytes(data), True, F.lit(fv.REASON_IMAGE_BYTES)),
        (ct.startswith("image/") & promised, True, F.lit(fv.REASON_PROMISED_IMAGE)),
        (html, False, F.lit(fv.REASON_HTML)),
        (texty, False, F.concat(F.lit(fv.REASON_TYPE), ct, F.lit(fv.REASON_NOT_IMAGE))),
        (unknown & (size >= MIN_IMAGE_BYTES), False, F.lit(fv.REASON_UNKNOWN_BYTES)),
        (unknown & long_enough, True, F.lit(fv.REASON_UNKNOWN_PROMISED)),
        (unknown, False, F.concat(F.lit(fv.REASON_TYPE), shown, F.lit(fv.REASON_BYTES_NOT_IMAGE))),
        (ct.isin(*IMAGE_TYPES), False, F.lit(fv.REASON_UNLIKE_IMAGE)),
        (F.lit(True), False, F.concat(F.lit(fv.REASON_UNKNOWN_TYPE), ct, F.lit(fv.REASON_BYTES_NOT_IMAGE))),
    ]
    return _decide(assets, rules)


def asset_validity_older(assets: DataFrame, content_type: str = "content_type",
                         sniff: str = "sniff", length: str = "content_length") -> DataFrame:
    """The older, stricter rules: text-like bytes are refused first."""
    ct, data = _plain_type(F.col(content_type)), F.col(sniff)
    body = F.ltrim(_bytes_text(data))
    low, size = F.lower(body), F.length(body)
    printable = F.length(F.regexp_replace(body, r"[^\x20-\x7e\t\n\r]", ""))
    texty = low.startswith("<!doctype html") | low.startswith("<html") | (
        (size > 0) & (printable / F.greatest(size, F.lit(1)) > 0.95)
    )
    magic, listed = image_bytes(data, newer=False), ct.isin(*OLDER_IMAGE_TYPES)
    shown = F.when(ct == "", F.lit(fv.REASON_MISSING_TYPE)).otherwise(ct)
    empty = F.coalesce(F.length(data), F.lit(0)) == 0
    rules = [
        (texty, False, F.lit(fv.REASON_TEXT_BYTES)),
        (~listed & magic, True, F.lit(fv.REASON_MISLABELLED)),
        (~listed, False, F.concat(F.lit(fv.REASON_TYPE), shown, F.lit(fv.REASON_BYTES_NOT_IMAGE))),
        (magic, True, F.lit(fv.REASON_OK)),
        (empty & (F.coalesce(F.col(length), F.lit(0)) > 0), True,
         F.lit(fv.REASON_ALLOWED_PROMISED)),
        (F.lit(True), False, F.lit(fv.REASON_ALLOWED_OTHER)),
    ]
    return _decide(assets, rules)


def _decide(assets: DataFrame, rules: list) -> DataFrame:
    verdict = F.lit(None)
    for condition, accepted, reason in reversed(rules):
        verdict = F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(F.lit(accepted).alias("is_image"), reason.alias("reason")),
        ).otherwise(verdict)
    return assets.withColumn("_v", verdict).select(*assets.columns, "_v.is_image", "_v.reason")


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("is_image", "reason").agg(F.count(F.lit(1)).alias("assets"))
