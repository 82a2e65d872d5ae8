"""Keyed streaming state: reuse of fresh results, task status."""

from pyspark.sql import functions as F

from pairwright.streaming import state
from tests.conftest import rows

HOUR = 3_600_000


def played(spark, tmp_path, batches, schema, make, time, delay="0 seconds"):
    """The rows of each batch, one file a batch; ``time`` is the column of the watermark, in ms."""
    for i, batch in enumerate(batches):
        made = spark.createDataFrame(batch, schema).coalesce(1)
        made.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = make(stream.withColumn("at", F.timestamp_millis(F.expr(time))).withWatermark("at", delay))
    found = []
    query = (out.writeStream.foreachBatch(lambda df, _: found.append(sorted(rows(df), key=str)))
             .option("checkpointLocation", f"{tmp_path}/state")
             .outputMode("update" if "status" in out.columns else "append").trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    return found


def test_fresh_results_are_reused(spark, tmp_path):
    first = [("a", 400_000), ("a", 1000), ("a", 60_000), ("b", 5)]
    later = [("a", 401_000), ("a", 1_200_000), ("c", 1_200_000)]
    got = played(spark, tmp_path, [first, later], "request_key string, created long", state.match_freshness_stream, "created")
    assert sorted(r for batch in got for r in batch) == [
        ("a", 1000, False), ("a", 60_000, True), ("a", 400_000, False), ("a", 401_000, True), ("a", 1_200_000, False),
        ("b", 5, False), ("c", 1_200_000, False)]


def test_task_states(spark, tmp_path):
    schema = "task_id string, status string, result string, created long, seq long, updated long"
    batches = [
        [("t", "completed", None, 0, 3, 3), ("t", "processing", "r1", 0, 2, 2), ("t", "pending", "r0", 0, 1, 1)],
        [("t", "processing", "old", 0, 0, HOUR // 2), ("u", "pending", None, HOUR // 2, 1, HOUR // 2)],
        [("t", "completed", "r4", 0, 4, HOUR - 9), ("v", "pending", None, HOUR, 1, HOUR + 5000)],
        [("w", "pending", None, HOUR, 1, HOUR + 6000)],
        [("t", "processing", "r5", 0, 5, HOUR + 7000)],
    ]
    got = played(spark, tmp_path, batches, schema, state.task_status_stream, "updated")
    told = [r[:4] for batch in got for r in batch if r[0] == "t"]
    assert told[:3] == [("t", "completed", "r1", 3), ("t", "completed", "r1", 3), ("t", "completed", "r4", 4)]
    assert ("t", "expired", "r4", 4) in told[3:] and {r[1] for r in told[3:]} == {"expired"}
    assert not any(r[1] == "expired" for batch in got for r in batch if r[0] != "t")


def test_ordered_freshness_does_not_depend_on_arrival(spark, tmp_path):
    made = [("a", 400_000), ("a", 1000), ("a", 60_000), ("b", 5), ("a", 401_000), ("a", 301_001)]
    end = ("z", 9_000_000)
    for i, batches in enumerate(([made, [end]], [made[:3], made[3:], [end]], [[*reversed(made)], [end]])):
        schema = "request_key string, created long"
        path = tmp_path / str(i)
        got = played(spark, path, batches, schema, lambda s: state.match_freshness_stream(s, ordered=True), "created", "10 minutes")
        assert sorted(r for batch in got for r in batch) == [
            ("a", 1000, False), ("a", 60_000, True), ("a", 301_001, False), ("a", 400_000, True), ("a", 401_000, True), ("b", 5, False)]


def test_gauges_are_kept_over_windows(spark, tmp_path):
    second = 1_000_000
    batches = [
        [("g", 2.0, 11 * second), ("g", 1.0, 4 * second), ("h", 7.0, second), ("g", None, 5 * second)],
        [("g", 3.0, 8 * second), ("g", 4.0, 41 * second), ("g", 5.0, 41 * second)],
        [("z", 0.0, 3600 * second)],
        [("g", 9.0, 12 * second), ("z", 0.0, 3700 * second)],  # far too late: left out
    ]
    got = played(spark, tmp_path, batches, "name string, gauge double, created long",
                 state.carry_gauges_stream, "created div 1000", "30 seconds")
    told = [r for batch in got for r in batch if r[0] != "z"]
    assert sorted(told, key=str) == sorted([
        ("g", 3.0, 0, None), ("g", 3.0, 0, 10 * second), ("g", 2.0, 10 * second, None), ("g", 2.0, 10 * second, 40 * second),
        ("g", 5.0, 40 * second, None), ("h", 7.0, 0, None)], key=str)
