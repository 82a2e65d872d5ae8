"""Job-search predicates: as single columns, and for whole request tables at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.geo import geo_distance
from pairwright.operators.geo import levels_in_use, own_cell, radius_level, reach_cells
from pairwright.operators.skew import DEFAULT_SALTS, salted_join
from pairwright.session import cut_lineage

FILTER_COLUMNS = ("locations", "keywords", "experience", "company", "is_remote_only", "fields")


def has_embedding(vector: str = "embedding") -> Column:
    return F.col(vector).isNotNull()


def country_name(country: Column) -> Column:
    """Request country as stored in the country table."""
    renamed = country
    for short, full in fv.COUNTRY_ALIASES.items():
        renamed = F.when(country == short, F.lit(full)).otherwise(renamed)
    return renamed


def phrase_matches(title: Column, description: Column, phrase: Column) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` in the phrase stay wildcards."""
    plain = F.regexp_replace(phrase, r"\\(?![%_\\])", "")
    pattern = F.concat(F.lit("%"), plain, F.lit("%"))
    return F.coalesce(F.ilike(title, pattern), F.lit(False)) | F.coalesce(
        F.ilike(description, pattern), F.lit(False)
    )


_WILD = r"[%_\\\\]"


def _plain(pattern: Column) -> Column:
    """The lower-cased pattern when it has no wildcards, so that it need not be compiled per row."""
    return F.when(~pattern.rlike(_WILD), F.lower(pattern))


def company_matches(company_name: Column, wanted: Column) -> Column:
    return F.coalesce(F.ilike(company_name, wanted), F.lit(False))


def is_remote(city: Column) -> Column:
    """Remote-only test: the word anywhere in the city, in any case."""
    return F.coalesce(F.lower(city).contains(fv.REMOTE_CITY), F.lit(False))


def experience_in(column: Column, wanted: Sequence[str]) -> Column:
    """Any of the legal levels; no legal level means no filter."""
    legal = [w for w in wanted if w in fv.EXPERIENCE_LEVELS]
    return F.coalesce(column.isin(*legal), F.lit(False)) if legal else F.lit(True)


def location_matches(
    locations: Sequence[dict], city: Column, country: Column, lat: Column, lon: Column
) -> Column:
    """One request's locations: country AND (radius OR city), OR over the locations."""
    options = []
    for loc in locations:
        parts = []
        if loc.get("country"):
            parts.append(country == fv.COUNTRY_ALIASES.get(loc["country"], loc["country"]))
        if loc.get("latitude") is not None and loc.get("longitude") is not None:
            radius = loc.get("radius_km")
            metres = 1000.0 * (fv.DEFAULT_RADIUS_KM if radius is None else radius)
            away = geo_distance(F.lit(loc["latitude"]), F.lit(loc["longitude"]), lat, lon)
            parts.append((city == fv.REMOTE_CITY) | F.coalesce(away <= metres, F.lit(False)))
        elif loc.get("city"):
            parts.append((city == loc["city"]) | (city == fv.REMOTE_CITY))
        if parts:
            option = parts[0]
            for part in parts[1:]:
                option = option & part
            options.append(F.coalesce(option, F.lit(False)))
    if not options:
        return F.lit(True)
    result = options[0]
    for option in options[1:]:
        result = result | option
    return result


def filter_fields(jobs: DataFrame, bridge: DataFrame, field_ids: Sequence[int],
                  job_id: str = "job_id", field_id: str = "field_id") -> DataFrame:
    """Jobs linked to any of the wanted fields."""
    wanted = bridge.where(F.col(field_id).isin(*field_ids)).select(job_id)
    return jobs.join(wanted, job_id, "left_semi")


def filter_similarity_band(df: DataFrame, similarity: str = "similarity",
                           band: tuple[float, float] = fv.SIMILARITY_BAND) -> DataFrame:
    return df.where(F.col(similarity).between(*band))


def filter_required_fields(df: DataFrame, job_id: str = "job_id", title: str = "title") -> DataFrame:
    """Rows that can become matches: an id that is set, and a title."""
    id_set = F.col(job_id).isNotNull() & (F.col(job_id).cast("string") != "")
    return df.where(id_set & F.col(title).isNotNull())


def filter_retention(requests: DataFrame, as_of: Column, time: str = "time",
                     days: int = fv.REQUEST_RETENTION_DAYS) -> DataFrame:
    """Requests that are kept; everything older than ``days`` goes."""
    return requests.where(F.col(time) >= as_of - F.make_dt_interval(F.lit(days)))


# --- request tables ----------------------------------------------------------------
def filter_signature() -> Column:
    """Requests with equal filters share one candidate set."""
    return F.sha2(F.to_json(F.struct(*FILTER_COLUMNS), {"ignoreNullFields": "false"}), 256)


def _alternatives(requests: DataFrame) -> DataFrame:
    """One row per (request, way to satisfy its location and experience filters)."""

    def useful(loc: Column) -> Column:
        geo = loc["latitude"].isNotNull() & loc["longitude"].isNotNull()
        named = F.coalesce(loc["country"], F.lit("")) != ""
        return geo | named | (F.coalesce(loc["city"], F.lit("")) != "")

    located = F.filter(F.coalesce("locations", F.lit([]).cast(requests.schema["locations"].dataType)), useful)
    legal = F.array_intersect(F.col("experience"), F.array(*[F.lit(e) for e in fv.EXPERIENCE_LEVELS]))
    levels = F.when(F.coalesce(F.size(legal), F.lit(0)) > 0, legal).otherwise(F.array(F.lit("*")))
    radius = F.coalesce(F.col("_loc.radius_km"), F.lit(fv.DEFAULT_RADIUS_KM))
    geo = F.col("_loc.latitude").isNotNull() & F.col("_loc.longitude").isNotNull()
    return (
        requests.withColumn("_locations", located)
        .select("*", F.posexplode_outer("_locations").alias("_at", "_loc"))
        .withColumn("_experience", F.explode(levels))
        .withColumn("_radius_m", F.when(geo, radius * 1000.0))
        .withColumn("_earlier", F.slice("_locations", 1, F.coalesce("_at", F.lit(0))))
        .withColumn(
            "_country",
            F.coalesce(country_name(F.nullif(F.col("_loc.country"), F.lit(""))), F.lit("*")),
        )
    )


def _satisfies(loc: Column) -> Column:
    """Whether the job of a joined row satisfies one location of its request."""
    country, city = country_name(F.nullif(loc["country"], F.lit(""))), F.nullif(loc["city"], F.lit(""))
    metres = F.coalesce(loc["radius_km"], F.lit(fv.DEFAULT_RADIUS_KM)) * 1000.0
    away = geo_distance(loc["latitude"], loc["longitude"], F.col("latitude"), F.col("longitude"))
    remote = F.col("city") == fv.REMOTE_CITY
    place = (
        F.when(loc["latitude"].isNotNull() & loc["longitude"].isNotNull(), remote | (away <= metres))
        .when(city.isNotNull(), remote | (F.col("city") == city)).otherwise(F.lit(True))
    )
    return F.coalesce((country.isNull() | (F.col("country") == country)) & place, F.lit(False))


def _place_keys(geo_level: Column) -> Column:
    """Keys under which a request alternative looks places up."""
    remote = F.lit(f"c:{fv.REMOTE_CITY}")
    cells = F.transform(
        reach_cells(F.col("_loc.latitude"), F.col("_loc.longitude"), geo_level),
        lambda c: F.concat(F.lit("g:"), c.cast("string")),
    )
    city = F.col("_loc.city")
    return (
        F.when(F.col("_radius_m").isNotNull(), F.concat(cells, F.array(remote)))
        .when(F.coalesce(city, F.lit("")) != "",
              F.array_distinct(F.array(F.concat(F.lit("c:"), city), remote)))
        .otherwise(F.array(F.lit("*")))
    )


_ANY_FIELD = -1


def _with_field_keys(
    asked: DataFrame, jobs: DataFrame, bridge: DataFrame | None, job_id: str
) -> tuple[DataFrame, DataFrame]:
    """Request rows per wanted field (or 'any'), and jobs with the wanted ones of their fields.

    Only links to fields somebody asks for are folded, so a job's list stays short.
    """
    if bridge is None:
        none = F.array().cast("array<bigint>")
        return (
            asked.withColumn("_fields", none).withColumn("_field", F.lit(_ANY_FIELD).cast("bigint")),
            jobs.withColumn("_job_fields", none),
        )
    wanted = asked.select(F.explode("_fields").alias("field_id")).distinct()
    linked = (
        bridge.select(job_id, F.col("field_id").cast("bigint").alias("field_id"))
        .join(wanted, "field_id", "left_semi")
        .groupBy(job_id).agg(F.collect_set("field_id").alias("_job_fields"))
    )
    per_field = F.when(F.size("_fields") > 0, F.col("_fields")).otherwise(
        F.array(F.lit(_ANY_FIELD).cast("bigint"))
    )
    return (
        asked.select("*", F.explode(per_field).alias("_field")),
        jobs.join(linked, job_id, "left").withColumn(
            "_job_fields", F.coalesce("_job_fields", F.array().cast("array<bigint>"))
        ),
    )


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, and an empty one."""
    return F.transform(F.array(F.split(text, "")), lambda letters: F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.slice(letters, 1, F.greatest(F.size(letters) - 2, F.lit(0))),
        lambda c, i: F.concat(c, F.get(letters, i + 1), F.get(letters, i + 2))))))[0]


def _with_phrases(asked: DataFrame, jobs: DataFrame, job_id: str) -> DataFrame:
    """Jobs with the asked phrases that their title or description holds, as ``_job_phrases``, and without their texts.

    Each phrase is looked up under the one of its three-letter runs that fewest jobs hold; a phrase without such a run
    (short, or cut up by wildcards) under the empty one, which every job has. Candidates are then checked whole.
    """
    phrases = asked.where(F.col("_phrase").isNotNull()).select("_phrase").distinct()
    pieces = F.split(F.lower("_phrase"), _WILD)
    runs = phrases.select("_phrase", F.explode(F.array_distinct(F.flatten(F.transform(pieces, _grams)))).alias("_gram"))
    texts = jobs.select(job_id, F.concat_ws("\n", F.lower("title"), F.lower("description")).alias("_text"))
    held = texts.select(job_id, F.explode(_grams(F.col("_text"))).alias("_gram"))
    common = held.join(runs.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_jobs"))
    # a run that no job holds is the rarest of all
    rarest = runs.join(common, "_gram", "left").groupBy("_phrase").agg(
        F.min_by("_gram", F.coalesce("_jobs", F.lit(0))).alias("_gram"))
    found = held.join(rarest, "_gram").groupBy(job_id).agg(F.collect_set("_phrase").alias("_found"))

    def holds(phrase: Column) -> Column:
        plain = F.lower(phrase)
        inside = F.coalesce(F.lower("title").contains(plain), F.lit(False)) | F.coalesce(
            F.lower("description").contains(plain), F.lit(False))
        return F.when(phrase.rlike(_WILD), phrase_matches(F.col("title"), F.col("description"), phrase)).otherwise(inside)

    none = F.array().cast("array<string>")
    return jobs.join(found, job_id, "left").withColumn(
        "_job_phrases", F.filter(F.coalesce("_found", none), holds)).drop("_found", "title", "description")


def eligible_pairs(
    requests: DataFrame, jobs: DataFrame, bridge: DataFrame | None = None,
    keep: Sequence[str] = (), salts: int = DEFAULT_SALTS,
    request_id: str = "request_id", job_id: str = "job_id",
) -> DataFrame:
    """Every (request, job) pair that passes all of the request's filters.

    Requests carry ``locations, keywords, experience, company, is_remote_only, fields``; jobs
    carry ``title, description, experience, company_name, city, country, latitude,
    longitude``. Country, experience, place (city, grid cell or 'any'), field and phrase become one equality
    join with wildcards over narrow rows; titles and descriptions stay out of it, and the pairs need no further
    shuffle. Many requests with the same filters should be one row here (see
    ``match_request_key``). ``keep`` names job columns to carry along.
    """
    ways = _alternatives(requests)
    levels = levels_in_use(ways.where(F.col("_radius_m").isNotNull()), F.col("_radius_m")).scalar()
    asked = ways.withColumn("_place", F.explode(_place_keys(radius_level(F.col("_radius_m"))))).select(
        request_id, "_country", "_experience", "_place", "_radius_m", "_earlier",
        F.coalesce(F.array_distinct(F.col("fields").cast("array<bigint>")), F.array().cast("array<bigint>"))
        .alias("_fields"),
        F.col("_loc.latitude").alias("_lat"), F.col("_loc.longitude").alias("_lon"),
        F.trim(F.get("keywords", F.lit(0))).alias("_phrase"),
        F.nullif(F.col("company"), F.lit("")).alias("_company"),
        F.coalesce("is_remote_only", F.lit(False)).alias("_remote"),
    ).withColumns({
        "_text": F.coalesce(F.concat(F.lit("t:"), "_phrase"), F.lit("*")), "_plain_company": _plain(F.col("_company")),
    })
    job_cells = F.when(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        F.transform(
            F.coalesce("_levels", F.array().cast("array<int>")),
            lambda level: F.concat(
                F.lit("g:"), own_cell(F.col("latitude"), F.col("longitude"), level).cast("string")
            ),
        ),
    )
    read = ["experience", "company_name", "city", "country", "latitude", "longitude"]
    narrow = jobs.select(job_id, "title", "description", *read, *[c for c in keep if c not in (*read, "title", "description")],
                         *[F.col(c).alias(f"_{c}") for c in keep if c in ("title", "description")])
    asked, keyed_jobs = _with_field_keys(asked, _with_phrases(asked, narrow, job_id), bridge, job_id)
    kept = [F.col(f"_{c}" if c in ("title", "description") else c).alias(c) for c in keep if c not in read]
    keyed = (
        keyed_jobs.select(job_id, *read, *kept, "_job_fields", "_job_phrases", levels.alias("_levels"))
        .select("*", F.explode(F.array_compact(F.array(F.lit("*"), F.col("country")))).alias("_country"))
        .select("*", F.explode(F.array_compact(F.array(F.lit("*"), F.col("experience")))).alias("_experience"))
        .select("*", F.explode(F.concat(
            F.array_compact(F.array(F.lit("*"), F.concat(F.lit("c:"), F.col("city")))),
            F.coalesce(job_cells, F.array().cast("array<string>")),
        )).alias("_place"))
        .select("*", F.explode(F.concat(F.array(F.lit(_ANY_FIELD)), "_job_fields")).alias("_field"))
        .select("*", F.explode(F.concat(F.array(F.lit("*")), F.transform(
            "_job_phrases", lambda phrase: F.concat(F.lit("t:"), phrase)))).alias("_text"))
        .drop("_job_phrases")
    )
    keys = ["_country", "_experience", "_place", "_field", "_text"]
    keyed = keyed.join(asked.select(*keys).distinct(), keys, "left_semi")
    away = geo_distance(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    # remote jobs are found under their city, so a cell never finds them a second time
    settled = F.coalesce(F.col("city") != fv.REMOTE_CITY, F.lit(True))
    near = ~F.col("_place").startswith("g:") | (
        settled & F.coalesce(away <= F.col("_radius_m"), F.lit(False))
    )
    # a pair counts for the first location it satisfies: no pair is found twice
    first = (F.size("_earlier") <= 0) | ~F.exists("_earlier", _satisfies)
    common = F.get(F.array_intersect("_fields", "_job_fields"), F.lit(0))
    first_field = (F.col("_field") == _ANY_FIELD) | (F.col("_field") == common)
    company = (
        F.when(F.col("_company").isNull(), F.lit(True))
        .when(F.col("_plain_company").isNotNull(),
              F.coalesce(F.lower("company_name") == F.col("_plain_company"), F.lit(False)))
        .otherwise(company_matches(F.col("company_name"), F.col("_company")))
    )
    remote = ~F.col("_remote") | is_remote(F.col("city"))
    return salted_join(
        keyed, asked, keys, salts=salts,
        extra=remote & company & near & first & first_field, spread_by=[job_id],
    ).select(request_id, job_id, *keep)


def _asked_companies(forms: DataFrame, jobs: DataFrame) -> DataFrame:
    """The distinct company names of ``jobs`` that some request names; patterns alone are compared one by one."""
    wanted = forms.select(F.nullif(F.col("company"), F.lit("")).alias("_wanted")).dropna().distinct().withColumn(
        "_plain", _plain(F.col("_wanted")))
    names = jobs.select("company_name").dropna().distinct()
    plain = wanted.where(F.col("_plain").isNotNull()).select("_plain").distinct()
    patterns = wanted.where(F.col("_plain").isNull()).select("_wanted")
    named = names.join(plain, F.lower("company_name") == F.col("_plain"), "left_semi")
    alike = names.join(patterns, company_matches(F.col("company_name"), F.col("_wanted")), "left_semi")
    return named.union(alike).distinct()


def eligible_counts(
    requests: DataFrame, jobs: DataFrame, bridge: DataFrame | None = None,
    request_id: str = "request_id", job_id: str = "job_id",
) -> DataFrame:
    """``request_id, jobs, job_sum``: the number of ``eligible_pairs`` of every request that has any, and the sum of their job ids.

    Pairs grow with requests times jobs, counts need not: requests with equal filters are one row, and so are jobs that
    no filter tells apart. Of a job's companies and fields only those that somebody asks for tell jobs apart.
    """
    signed = requests.withColumn("_signature", filter_signature())
    forms = cut_lineage(signed.groupBy("_signature").agg(
        F.first(F.struct(*FILTER_COLUMNS), ignorenulls=False).alias("_f")).select("_signature", "_f.*"))
    read = ["title", "description", "experience", "company_name", "city", "country", "latitude", "longitude"]
    rows = jobs.select(job_id, *read)
    asked_names = _asked_companies(forms, rows).select("company_name", F.col("company_name").alias("_asked_name"))
    rows = rows.join(asked_names, "company_name", "left").withColumn("company_name", F.col("_asked_name")).drop("_asked_name")
    if bridge is None:
        rows = rows.withColumn("_links", F.array().cast("array<bigint>"))
    else:
        fields = forms.select(F.explode(F.col("fields").cast("array<bigint>")).alias("field_id")).dropna().distinct()
        links = bridge.select(job_id, F.col("field_id").cast("bigint").alias("field_id")).join(
            fields, "field_id", "left_semi").groupBy(job_id).agg(F.array_sort(F.collect_set("field_id")).alias("_links"))
        rows = rows.join(links, job_id, "left")
    kinds = cut_lineage(rows.groupBy(*read, "_links").agg(
        F.min(job_id).alias("_kind"), F.count(F.lit(1)).alias("_jobs"), F.sum(job_id).cast("bigint").alias("_job_sum")))
    own_links = None if bridge is None else kinds.select("_kind", F.explode("_links").alias("field_id"))
    pairs = eligible_pairs(forms, kinds, own_links, ("_jobs", "_job_sum"), request_id="_signature", job_id="_kind")
    counts = pairs.groupBy("_signature").agg(F.sum("_jobs").alias("_jobs"), F.sum("_job_sum").alias("_job_sum"))
    return signed.select(request_id, "_signature").join(counts, "_signature").groupBy(request_id).agg(
        F.sum("_jobs").alias("jobs"), F.sum("_job_sum").cast("bigint").alias("job_sum"))
