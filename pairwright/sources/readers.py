"""Scans: every reader returns a DataFrame with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import blank_to_null
from pairwright.operators.joins import join_star_left
from pairwright.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet",
               **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A database table read by ranges of a numeric column, many connections at a time."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = (
            reader.option("partitionColumn", column).option("lowerBound", bounds[0])
            .option("upperBound", bounds[1]).option("numPartitions", partitions)
        )
    return reader.load()


def scan_jobs_star(jobs: DataFrame, companies: DataFrame, locations: DataFrame,
                   countries: DataFrame) -> DataFrame:
    """Flat job rows; jobs without company, location or country stay."""
    joined = join_star_left(
        jobs, companies.withColumnRenamed("logo", "company_logo"), locations,
        countries.withColumnRenamed("country_name", "country"),
    )
    present = [c for c in schemas.STAR_COLUMNS if c in joined.columns]
    return joined.select(*present)


def job_text(title, description, short_description):
    """Title and description (else the short one), trimmed."""
    joined = F.concat_ws(
        " ", F.coalesce(title, F.lit("")),
        F.coalesce(blank_to_null(description), short_description, F.lit("")),
    )
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def scan_active_jobs_text(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """``job_id, text, embedding`` of active jobs that have both."""
    active = jobs.where((F.col("job_state") == "Active") & F.col("embedding").isNotNull())
    texts = active.select(
        "job_id", job_text(F.col("title"), F.col("description"), F.col("short_description")).alias("text"),
        "embedding",
    ).where(F.col("text") != "")
    return texts if limit is None else texts.limit(limit)


def scan_resumes(resumes: DataFrame, user_id: int | None = None, version: str | None = None) -> DataFrame:
    """Resumes with vector, text and user; one per user, the first by id."""
    usable = resumes.where(
        F.col("vector").isNotNull() & F.col("user_id").isNotNull()
        & (F.coalesce("text", F.lit("")) != "")
    )
    if user_id is not None:
        usable = usable.where(F.col("user_id") == user_id)
    if version is not None:
        usable = usable.where(F.col("version") == version)
    return usable.groupBy("user_id").agg(
        F.min_by(F.struct("resume_id", "text", "vector"), "resume_id").alias("_r")
    ).select("user_id", "_r.*")


def scan_applied_jobs(applied: DataFrame) -> DataFrame:
    """Flat (user_id, job_id) rows from list-valued or already flat rows."""
    if "job_ids" in applied.columns:
        applied = applied.select("user_id", F.explode("job_ids").alias("job_id"))
    return applied.select("user_id", "job_id").where(F.col("job_id").isNotNull())


def scan_cooled_jobs(cooled: DataFrame) -> DataFrame:
    return cooled.select("job_id").where(F.col("job_id").isNotNull())


def scan_rejected_jobs(rejected: DataFrame, user_id: int | None = None) -> DataFrame:
    """Rejected job ids, of one user or of all."""
    rows = rejected if user_id is None else rejected.where(F.col("user_id") == user_id)
    return rows.select("user_id", "job_id")


def scan_training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training samples from JSON lines, with defaults for missing fields."""
    rows = spark.read.schema(schemas.TRAINING_SAMPLES).json(f"{path}/samples")
    empty = F.array().cast("array<string>")
    return rows.select(
        "sample_id", "resume_id", "resume_text",
        F.coalesce("positive_job_id", F.lit("")).alias("positive_job_id"),
        F.coalesce("positive_job_text", F.lit("")).alias("positive_job_text"),
        F.coalesce("hard_negative_job_ids", empty).alias("hard_negative_job_ids"),
        F.coalesce("hard_negative_job_texts", empty).alias("hard_negative_job_texts"),
        F.coalesce("source", F.lit("application")).alias("source"),
        F.col("timestamp").try_cast("timestamp").alias("timestamp"),
        F.coalesce("mining_strategy", F.lit("combined")).alias("mining_strategy"),
    )


def scan_taxonomy_json(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(skills, relations) of taxonomy documents, each one JSON value.

    A document is read by one task; large graphs belong in the two tables that
    ``sink_taxonomy_json`` writes and ``scan_taxonomy_tables`` reads.
    """
    document = spark.read.schema(schemas.TAXONOMY).option("multiLine", multi_line).json(path)
    skills = document.select(F.posexplode("skills").alias("seq", "_s")).select(
        "_s.id", "_s.name", "_s.category",
        F.coalesce("_s.aliases", F.array().cast("array<string>")).alias("aliases"), "seq",
    )
    relations = document.select(F.posexplode("relations").alias("seq", "_r")).select(
        F.col("_r.source_id").alias("source"), F.col("_r.target_id").alias("target"),
        F.col("_r.relation_type").alias("relation"),
        F.coalesce("_r.weight", F.lit(1.0)).alias("weight"), "seq",
    )
    return skills, relations


def scan_taxonomy_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(skills, relations) of a taxonomy stored as two JSON-lines tables."""
    from pairwright.operators.graph import RELATION_SCHEMA, SKILL_SCHEMA

    return (
        spark.read.schema(SKILL_SCHEMA).json(f"{path}/skills"),
        spark.read.schema(RELATION_SCHEMA).json(f"{path}/relations"),
    )


def scan_raw_scores_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_SCORES).option("header", True).csv(path)


METRIC_NAME = r"\w+\.\w+(?:\.\w+)*"


def scan_statsd_log(spark: SparkSession, path: str) -> DataFrame:
    """Values of a metric dump: ``seq, section, name, value, count, min, avg, max``.

    The file splits at flush headers; ``seq`` orders the rows of a file. Counter and gauge
    rows carry a value, histogram rows their summary. Each flush is one record, so a dump of
    any length is read in parallel.
    """
    flushes = (
        spark.read.option("lineSep", "--- Metrics flush at ").text(path)
        .select(
            F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("flush"), "value",
        )
    )
    return parse_dump(flushes, "value", ["file", "block", "flush"])


def parse_dump(flushes: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Rows of flush texts; ``order`` columns put the flushes in sequence."""
    heads = "Counters:|Gauges:|Timers:|Histograms:"
    parts = F.regexp_extract_all(
        F.col(text), F.lit(rf"(?s)({heads})(.*?)(?=(?:{heads})|\z)"), F.lit(0)
    )
    sections = flushes.select(*order, F.posexplode(parts).alias("_section", "_body"))
    kind = F.lower(F.regexp_extract("_body", r"^(\w+?)s:", 1))
    lines = F.regexp_extract_all(
        F.col("_body"),
        F.lit(rf"{METRIC_NAME}\s*=\s*[\d.]+|{METRIC_NAME}\s+\(count=\d+, min=[\d.]+[a-z]*, "
              r"avg=[\d.]+[a-z]*, max=[\d.]+[a-z]*\)"),
        F.lit(0),
    )
    rows = sections.select(
        *order, "_section", kind.alias("section"), F.posexplode(lines).alias("_line", "_text")
    )

    def number(pattern: str):
        return F.regexp_extract("_text", pattern, 1).try_cast("double")

    return rows.select(
        F.struct(*order, "_section", "_line").alias("seq"), "section",
        F.regexp_extract("_text", rf"^({METRIC_NAME})", 1).alias("name"),
        number(r"=\s*([\d.]+)$").alias("value"), number(r"count=(\d+)").cast("bigint").alias("count"),
        number(r"min=([\d.]+)").alias("min"), number(r"avg=([\d.]+)").alias("avg"),
        number(r"max=([\d.]+)").alias("max"),
    )


def scan_company_logo_map(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed (input_company, identifier, position) rows of a logo map; positions follow file names, then lines."""
    rows = spark.read.schema(schemas.LOGO_MAP).option("header", True).csv(path)
    return rows.select(
        F.trim(F.coalesce("input_company", F.lit(""))).alias("input_company"),
        F.trim(F.coalesce("identifier", F.lit(""))).alias("identifier"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("position"),
    )


def saved_index(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(index, stats) as ``save_index`` stored them."""
    return spark.table(f"{name}_index"), spark.table(f"{name}_stats")
