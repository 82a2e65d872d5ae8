"""Streams give the same rows as the batch form."""

import os
from glob import glob

from pyspark.sql import functions as F

from pairwright.sources.writers import retain_days
from pairwright.streaming import metrics
from tests.conftest import rows


def run(stream, path, mode="append"):
    query = (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()


def lines(spark):
    made = [(i, f"m{i % 3}:{i}|{'cgms'[i % 3] if i % 3 < 2 else 'ms'}|@0.5|#k:v") for i in range(60)]
    df = spark.createDataFrame(made, "second int, value string")
    return df.select((F.lit(1_700_000_000) + F.col("second")).cast("timestamp").alias("ts"), "value")


def test_rollup_stream_equals_batch(spark, tmp_path):
    batch = lines(spark)
    batch.write.parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([(1_700_009_999, "end:1|c")], "s bigint, value string").select(F.col("s").cast("timestamp").alias("ts"), "value")
    end.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    rolled = metrics.statsd_rollup(metrics.parse_statsd(stream), by_tags=True)
    run(rolled, tmp_path)
    got = spark.read.schema(rolled.schema).parquet(f"{tmp_path}/out").where("name <> 'end'")
    want = metrics.statsd_rollup(metrics.parse_statsd(batch), by_tags=True)
    assert sorted(map(str, rows(got.select(want.columns)))) == sorted(map(str, rows(want))) and got.count() > 0


def test_request_rollup_and_outcomes_accept_streams(spark, tmp_path):
    base = spark.range(40).select(
        (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), F.lit("GET").alias("method"), F.lit("/a").alias("route"),
        F.when(F.col("id") % 4 == 0, 500).otherwise(200).alias("status_code"), (F.col("id") * 50.0).alias("duration_ms"),
        F.col("id").alias("request_size"), F.col("id").alias("response_size"), F.when(F.col("id") % 4 == 0, "Boom").alias("error_type"))
    base.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    rolled = metrics.http_request_rollup(stream)
    query = rolled.writeStream.format("memory").queryName("rollup_rows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = metrics.http_request_rollup(base)
    assert sorted(map(str, rows(spark.table("rollup_rows")))) == sorted(map(str, rows(want)))
    outcome = metrics.operation_outcomes(stream, operation="route", time="ts")
    query = outcome.writeStream.format("memory").queryName("outcome_rows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("outcome_rows").agg(F.sum("calls")).first()[0] == 40


def test_retries_count_once(spark, tmp_path):
    made = spark.range(50).select("id", (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").alias("ts"), F.lit("a").alias("operation"),
                                  F.lit(None).cast("string").alias("error_type"), F.lit(1.0).alias("duration_ms"))
    for part in (made.where("id < 30"), made.where("id >= 20")):  # ten retried in a later batch
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    outcome = metrics.operation_outcomes(metrics.once(stream, "id"), time="ts", watermark=None)
    outcome.writeStream.format("memory").queryName("once_rows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once_rows").agg(F.sum("calls")).first()[0] == 50
    assert metrics.once(made.union(made), "id").count() == 50


def test_retention_touches_old_days_only(spark, tmp_path):
    path = f"{tmp_path}/kept"
    base = spark.range(96).select("id", (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"))
    base.withColumn("day", F.to_date("time")).repartition("day").write.partitionBy("day").parquet(path)

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob(f"{path}/day=*/*.parquet")}

    before = files()
    assert retain_days(spark, path, F.lit("2024-03-02 05:30:00").cast("timestamp_ntz")) == 30
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(30, 96))
    after = files()
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if "03-03" in f or "03-04" in f}
    assert retain_days(spark, path, F.lit("2024-03-02 05:30:00").cast("timestamp_ntz")) == 0
    assert retain_days(spark, path, F.lit("2024-03-02 23:30:00").cast("timestamp_ntz")) == 18
    assert not glob(f"{path}/day=2024-03-02/*.parquet") and spark.read.parquet(path).count() == 48
    assert retain_days(spark, path, F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")) == 48
