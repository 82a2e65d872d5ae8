"""Sinks: every writer writes in parallel from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import search_tokens


def sink_training_jsonl(samples: DataFrame, path: str, test_share: float = 0.1,
                        validation_share: float = 0.1) -> None:
    """Samples as JSON lines without embeddings, and one metadata row beside them."""
    vectors = [c for c in samples.columns if c.endswith(("_embedding", "_embeddings"))]
    plain = samples.drop(*vectors)
    plain.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/samples")
    plain.sparkSession.read.json(f"{path}/samples", schema="sample_id string").agg(
        F.count(F.lit(1)).alias("sample_count"), F.lit(validation_share).alias("validation_split"),
        F.lit(test_share).alias("test_split"), F.current_timestamp().alias("created_at"),
    ).write.mode("overwrite").json(f"{path}/metadata")


def sink_taxonomy_json(skills: DataFrame, relations: DataFrame, path: str) -> None:
    """Skills and relations as two JSON-lines tables below ``path``."""
    skills.write.mode("overwrite").json(f"{path}/skills")
    relations.write.mode("overwrite").json(f"{path}/relations")


def sink_matches(matches: DataFrame, path: str, as_of: Column, fmt: str = "parquet",
                 mode: str = "append") -> None:
    """Match rows with their write time, partitioned by day."""
    stamped = matches.withColumn("timestamp", as_of).withColumn("run_date", F.to_date("timestamp"))
    stamped.write.mode(mode).format(fmt).partitionBy("run_date").save(path)


def search_request_rows(requests: DataFrame) -> DataFrame:
    """``user_id, time, location, keywords`` as logged: first location and keyword tokens.

    Only a missing coordinate leaves the location out; places on the equator or the prime meridian are logged.
    """
    first = F.get("locations", F.lit(0))
    lat, lon = first["latitude"], first["longitude"]
    usable = lat.isNotNull() & lon.isNotNull()
    return requests.select(
        "user_id", "time", F.when(usable, F.array(lat, lon)).alias("location"),
        F.when(F.size("keywords") > 0, search_tokens(F.col("keywords"))).alias("keywords"),
    )


def sink_search_requests(requests: DataFrame, path: str, checkpoint: str | None = None):
    """Append request rows; on a stream returns the started query."""
    rows = search_request_rows(requests).withColumn("day", F.to_date("time"))
    if requests.isStreaming:
        return (
            rows.writeStream.format("parquet").option("path", path).partitionBy("day")
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start()
        )
    rows.write.mode("append").partitionBy("day").parquet(path)
    return None


def retain_days(spark: SparkSession, path: str, before: Column, time: str = "time", day: str = "day") -> int:
    """Delete the rows of a parquet table, partitioned by the ``day`` of ``time``, that are older than ``before``.

    Only days that hold such rows are touched: the day of ``before`` is read and overwritten alone, earlier
    days are removed without reading their rows' values. Returns the number of deleted rows. Rows without a time stay.
    A day is replaced as a whole or not at all, and a second run after a lost one deletes what is left; its count
    then tells the rest only.
    """
    table = spark.read.parquet(path)
    last = F.to_date(before)
    whole = [r[0] for r in table.where(F.col(day) < last).select(day).distinct().collect()]  # one row a day
    deleted = table.where(F.col(day) < last).count()
    seen = Observation()
    kept = table.where(F.col(day) == last).observe(
        seen, F.count_if(F.col(time) < before).alias("deleted"), F.count(F.lit(1)).alias("rows")
    ).where(F.col(time) >= before)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    found = seen.get
    deleted += found["deleted"]
    if found["deleted"] and found["deleted"] == found["rows"]:  # nothing was left to overwrite the day with
        whole += [r[0] for r in table.where(F.col(day) == last).select(day).limit(1).collect()]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for gone in whole:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={gone}")
        folder.getFileSystem(hadoop).delete(folder, True)
    return deleted


def upsert_table(updated: DataFrame, path: str) -> None:
    """Replace a table's content; write beside the source, never over a path being read."""
    updated.write.mode("overwrite").parquet(path)


def save_index(index: DataFrame, stats: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Store the term index and its statistics as tables ``name_index`` and ``name_stats`` below ``path``.

    Both are bucketed and sorted by token, one file a bucket, so searches join them by token without a shuffle.
    Choose ``buckets`` so that one holds some hundred MB.
    """
    for kind, table in (("index", index), ("stats", stats)):
        table.repartition(buckets, "token").write.mode("overwrite").bucketBy(buckets, "token").sortBy("token").option(
            "path", f"{path}/{kind}").saveAsTable(f"{name}_{kind}")
