"""Operational roll-ups over all events; the event type is the operation, the value its time."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators.maintenance import match_freshness, task_latest_status
from pairwright.session import scratch_path
from pairwright.sources.writers import retain_days
from pairwright.streaming import metrics
from pairwright.streaming.state import carry_gauges_stream, match_freshness_stream, task_status_stream
from pairwright.workload import tables as t
from pairwright.workload.registry import query
from pairwright.workload.rollups import rounded

KIND_SQL = "CASE event_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'g' WHEN 2 THEN 'ms' ELSE 'h' END"


def lines(events):
    """Each event as one metric line, with a rate on some and tags on all; some are malformed."""
    key = F.col("event_id")
    kind = F.element_at(F.array(F.lit("c"), F.lit("g"), F.lit("ms"), F.lit("h")), (key % 4 + 1).cast("int"))
    value = F.when(key % 13 == 0, F.lit("oops")).otherwise(F.format_string("%.2f", F.col("value")))
    return events.select(
        "event_id", "ts",
        F.concat(F.col("event_type"), F.lit(".total:"), value, F.lit("|"), kind,
                 F.when(key % 3 == 0, F.lit("|@0.5")).otherwise(F.lit("")),
                 F.lit("|#user:"), (F.col("user_id") % 3).cast("string"), F.lit(",bad,k:v")).alias("value"))


PARSED = f"""parsed AS (SELECT event_id, ts, event_type || '.total' AS name, value AS metric_value, {KIND_SQL} AS type,
  CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END AS sample_rate, (user_id % 3)::VARCHAR AS user_tag FROM events WHERE event_id % 13 <> 0)"""


@query("parse_statsd", f"WITH {PARSED} SELECT event_id, name, metric_value, type, sample_rate, user_tag, 'v' AS k_tag, 2 AS tags FROM parsed")
def _(spark, sf):
    parsed = metrics.parse_statsd(lines(t.table(spark, sf, "events")))
    return parsed.select("event_id", "name", "metric_value", "type", "sample_rate", F.col("tags")["user"].alias("user_tag"),
                         F.col("tags")["k"].alias("k_tag"), F.size("tags").alias("tags"))


ROLLED = """SELECT strftime(time_bucket(INTERVAL 10 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, name, type, count(*) AS samples,
  round(sum(CASE WHEN type = 'c' THEN metric_value / sample_rate END), 6) AS counter, max_by(CASE WHEN type = 'g' THEN metric_value END, CASE WHEN type = 'g' THEN ts END) AS gauge,
  min(CASE WHEN type IN ('ms', 'h') THEN metric_value END) AS min, round(avg(CASE WHEN type IN ('ms', 'h') THEN metric_value END), 6) AS avg, max(CASE WHEN type IN ('ms', 'h') THEN metric_value END) AS max
  FROM parsed GROUP BY 1, 2, 3"""


def shown(rolled):
    return rounded(rolled.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("statsd_rollup", f"WITH {PARSED} {ROLLED}")
def _(spark, sf):
    return shown(metrics.statsd_rollup(metrics.parse_statsd(lines(t.table(spark, sf, "events")))))


@query("statsd_rollup_by_tags", f"""WITH {PARSED} SELECT user_tag, name, count(*) AS windows, CAST(sum(samples) AS BIGINT) AS samples FROM
  (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, name, type, user_tag, count(*) AS samples FROM parsed GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
def _(spark, sf):
    rolled = metrics.statsd_rollup(metrics.parse_statsd(lines(t.table(spark, sf, "events"))), by_tags=True)
    return rolled.groupBy(F.get_json_object("tags", "$.user").alias("user_tag"), "name").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("samples").alias("samples"))


@query("statsd_rollup_stream", f"WITH {PARSED} {ROLLED}")
def _(spark, sf):
    """The same roll-up as a stream over the event files, run until the input is used up.

    A last line far in the future closes the last windows and is left out again.
    """
    schema = t.table(spark, sf, "events").schema
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "rollup")
    events = t.table(spark, sf, "events")
    events.write.parquet(inbox)
    closing = events.agg((F.max("ts") + F.make_dt_interval(F.lit(1))).alias("ts")).select(
        F.lit(1).cast("bigint").alias("event_id"), "ts", F.lit(0).cast("bigint").alias("user_id"),
        F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    closing.write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).parquet(inbox)
    rolled = metrics.statsd_rollup(metrics.parse_statsd(lines(stream)))
    (
        rolled.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "rollup-state"))
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    stored = spark.read.schema(rolled.schema).parquet(out)
    return shown(stored.where("name <> 'closing.total'"))


def streamed(spark, events, name, build):
    """Stored rows of an append-mode stream over event files, stopped halfway and resumed from its checkpoint.

    The second half ends with an event a day ahead, of type ``closing``, which closes the last windows.
    """
    inbox, out, state = (scratch_path(spark, f"{name}-{part}") for part in ("inbox", "rows", "state"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2) if low else F.current_timestamp()
    closing = events.agg((F.max("ts") + F.make_dt_interval(F.lit(1))).alias("ts"), F.max("event_id").alias("last")).select(
        (F.col("last") * 52 + 1).alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("closing").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    for half in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle).unionByName(closing)):
        half.write.mode("append").parquet(inbox)
        rows = build(spark.readStream.schema(events.schema).parquet(inbox))
        (
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(rows.schema).parquet(out)


def retried(events):
    """The events with every seventh one sent twice."""
    return events.unionByName(events.where(F.col("event_id") % 7 == 0))


KEPT_GAUGES = f"""WITH {PARSED}, g AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, name, max_by(metric_value, ts) AS gauge FROM parsed WHERE type = 'g' GROUP BY 1, 2)
  SELECT name, gauge, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(lead(w) OVER (PARTITION BY name ORDER BY w), '%Y-%m-%d %H:%M:%S') AS valid_until FROM g"""


@query("carry_gauges", KEPT_GAUGES)
def _(spark, sf):
    rolled = metrics.statsd_rollup(metrics.parse_statsd(lines(t.table(spark, sf, "events"))))
    kept = metrics.carry_gauges(rolled)
    return shown(kept.withColumn("valid_until", F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss")))


@query("carry_gauges_stream", KEPT_GAUGES)
def _(spark, sf):
    """The same as a stream; a row in force comes without an end first and again with it, so the highest end counts."""
    def build(events):
        parsed = metrics.timed(metrics.parse_statsd(lines(events)), "ts", "1 minute")
        return carry_gauges_stream(parsed.where("type = 'g'").select(
            "name", F.col("metric_value").alias("gauge"), F.unix_micros("ts").alias("created"), "ts"))
    told = streamed(spark, t.table(spark, sf, "events"), "gauges", build).where("name <> 'closing.total'")
    kept = told.groupBy("name", "window_start").agg(F.first("gauge").alias("gauge"), F.max("valid_until").alias("valid_until"))
    moment = {c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "valid_until")}
    return kept.withColumns(moment)


def http_requests(events):
    key = F.col("event_id")
    return events.select(
        "event_id", "ts", F.when(key % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("route"),
        F.when(F.col("event_type") == "error", 503).when(key % 5 == 0, 404).otherwise(200).alias("status_code"),
        (F.col("value") * 20).alias("duration_ms"), (key % 100).alias("request_size"), (key % 1000).alias("response_size"),
        F.when(F.col("event_type") == "error", "Boom").alias("error_type"))


REQUESTS = """SELECT strftime(time_bucket(INTERVAL 10 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || event_type AS route,
  CASE WHEN event_type = 'error' THEN '5xx' WHEN event_id % 5 = 0 THEN '4xx' ELSE '2xx' END AS status_range, count(*) AS requests, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors,
  round(min(value * 20), 6) AS min_ms, round(avg(value * 20), 6) AS avg_ms, round(max(value * 20), 6) AS max_ms, CAST(sum(CASE WHEN value * 20 > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS slow,
  max(event_id % 100) AS max_request_size, max(event_id % 1000) AS max_response_size FROM events GROUP BY 1, 2, 3, 4"""


@query("http_request_rollup", REQUESTS)
def _(spark, sf):
    return shown(metrics.http_request_rollup(http_requests(t.table(spark, sf, "events"))))


@query("http_request_rollup_stream", REQUESTS)
def _(spark, sf):
    """As a stream in which every seventh request is sent twice and counted once."""
    rolled = streamed(spark, retried(t.table(spark, sf, "events")), "requests", lambda events: metrics.http_request_rollup(
        metrics.once(http_requests(metrics.timed(events, "ts", "1 minute")), "event_id", watermark=None), watermark=None))
    return shown(rolled.where("route <> '/closing'"))


def operation_times(events):
    key = F.col("event_id") % 3
    return events.select(
        "event_id", "ts", F.when(key == 0, F.concat(F.lit("http."), F.col("event_type"), F.lit(".duration")))
        .when(key == 1, F.concat(F.lit("task."), F.col("event_type"), F.lit(".duration")))
        .otherwise(F.concat(F.lit("task."), F.col("event_type"))).alias("name"), (F.col("value") * 20).alias("value"))


@query("slow_operation_events_stream", """WITH e AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS w, CASE event_id % 3 WHEN 0 THEN 'http.' ELSE 'task.' END || event_type AS base, value * 20 AS v, event_id % 3 AS k FROM events),
  r AS (SELECT w, base || '.slow' AS metric, 'c' AS type, 1.0::DOUBLE AS value FROM e WHERE k < 2 AND v > 1000
    UNION ALL SELECT w, base || '.slow_duration_ms', 'g', v FROM e WHERE k < 2 AND v > 1000
    UNION ALL SELECT w, base || '.duration_distribution', 'h', v FROM e WHERE k = 0 OR k = 1 AND v > 1000
    UNION ALL SELECT w, base || '.duration_distribution', 'h', v FROM e WHERE k = 0 AND v > 1000)
  SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, metric AS name, type, count(*) AS samples, sum(CASE WHEN type = 'c' THEN value END) AS counter,
  round(min(CASE WHEN type = 'h' THEN value END), 6) AS min, round(avg(CASE WHEN type = 'h' THEN value END), 6) AS avg, round(max(CASE WHEN type = 'h' THEN value END), 6) AS max FROM r GROUP BY w, metric, type""")
def _(spark, sf):
    """Slow operations of a stream with retries, derived and rolled up by flush window."""
    def build(events):
        rows = metrics.slow_operation_events(operation_times(metrics.once(events, "event_id")))
        return metrics.statsd_rollup(rows.select("ts", F.col("metric").alias("name"), "type", F.col("value").alias("metric_value"),
                                                 F.lit(1.0).alias("sample_rate")), watermark=None)
    rolled = streamed(spark, retried(t.table(spark, sf, "events")), "slow", build)
    return shown(rolled.where(~F.col("name").contains(".closing")).drop("gauge"))


@query("slow_operation_events", """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'http.' || event_type || '.duration' WHEN 1 THEN 'task.' || event_type || '.duration' ELSE 'task.' || event_type END AS name, value * 20 AS v, event_id % 3 AS k, event_type FROM events)
  SELECT metric, type, count(*) AS rows, round(sum(value), 4) AS total FROM (
  SELECT (CASE k WHEN 0 THEN 'http.' ELSE 'task.' END) || event_type || '.slow' AS metric, 'c' AS type, 1.0::DOUBLE AS value FROM e WHERE k < 2 AND v > 1000
  UNION ALL SELECT (CASE k WHEN 0 THEN 'http.' ELSE 'task.' END) || event_type || '.slow_duration_ms', 'g', v FROM e WHERE k < 2 AND v > 1000
  UNION ALL SELECT (CASE k WHEN 0 THEN 'http.' ELSE 'task.' END) || event_type || '.duration_distribution', 'h', v FROM e WHERE k < 2 AND v > 1000
  UNION ALL SELECT 'http.' || event_type || '.duration_distribution', 'h', v FROM e WHERE k = 0) GROUP BY 1, 2""")
def _(spark, sf):
    rows = metrics.slow_operation_events(operation_times(t.table(spark, sf, "events")))
    return rounded(rows.groupBy("metric", "type").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")), digits=4)


@query("slow_query_events", """SELECT metric, type, duration_category, count(*) AS rows FROM (
  SELECT 'db.query.duration_distribution' AS metric, 'h' AS type, value * 20 AS v FROM events
  UNION ALL SELECT 'db.query.slow.' || event_type || '.duration_ms', 'g', value * 20 FROM events WHERE value * 20 > 500 UNION ALL SELECT 'db.query.slow', 'c', value * 20 FROM events WHERE value * 20 > 500)
  CROSS JOIN LATERAL (SELECT CASE WHEN v < 50 THEN 'fast' WHEN v < 200 THEN 'medium' WHEN v < 500 THEN 'slow' WHEN v < 2000 THEN 'very_slow' WHEN v < 10000 THEN 'extremely_slow' ELSE 'critical' END AS duration_category) GROUP BY 1, 2, 3""")
def _(spark, sf):
    timed = t.table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("value") * 20).alias("value"))
    rows = metrics.slow_operation_events(timed, database=True)
    return rows.groupBy("metric", "type", "duration_category").agg(F.count(F.lit(1)).alias("rows"))


def operations(events):
    return events.select(
        F.col("user_id").alias("operation"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_type"),
        F.col("value").alias("duration_ms"), "ts")


@query("operation_outcomes", """SELECT user_id AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN props END AS error_type,
  count(*) AS calls, min(value) AS min_ms, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(metrics.operation_outcomes(operations(t.table(spark, sf, "events"))))


@query("operation_outcomes_stream", """SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_type = 'error' THEN props END AS error_type, count(*) AS calls, round(min(value), 6) AS min_ms, round(avg(value), 6) AS avg_ms, round(max(value), 6) AS max_ms FROM events GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Outcomes by minute of a stream with retries."""
    rolled = streamed(spark, retried(t.table(spark, sf, "events")), "outcomes", lambda events: metrics.operation_outcomes(
        operations(metrics.once(events, "event_id")), time="ts", watermark=None))
    return shown(rolled.where("operation >= 0").withColumn("window_start", F.col("window.start")).drop("window"))


@query("bottleneck_report", """WITH s AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'db.query.q' || user_id || '.duration' WHEN 1 THEN 'algorithm.step' || user_id WHEN 2 THEN 'http.response.size' ELSE 'svc.http.requests.slow' END AS name, value * 100 AS v FROM events),
  l AS (SELECT name, max_by(v, event_id) AS last, sum(v) AS total FROM s GROUP BY 1),
  f AS (SELECT 'database' AS finding, name AS metric, last AS value, 1 AS w FROM l WHERE name LIKE 'db.query%' AND last > 500 UNION ALL SELECT 'algorithm', name, last, 2 FROM l WHERE name LIKE 'algorithm%' AND last > 1000
    UNION ALL SELECT 'response_size', name, last, 3 FROM l WHERE name = 'http.response.size' AND last > 10000 UNION ALL SELECT 'slow_requests', name, total, 4 FROM l WHERE name LIKE '%http.requests.slow')
  SELECT finding, metric, round(value, 4) AS value, coalesce((SELECT min_by(finding, w) FROM f WHERE w < 4), 'none') AS verdict FROM f""")
def _(spark, sf):
    kind = F.col("user_id") % 4
    samples = t.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.lit("gauge").alias("section"), (F.col("value") * 100).alias("value"),
        F.when(kind == 0, F.concat(F.lit("db.query.q"), F.col("user_id"), F.lit(".duration")))
        .when(kind == 1, F.concat(F.lit("algorithm.step"), F.col("user_id"))).when(kind == 2, "http.response.size")
        .otherwise("svc.http.requests.slow").alias("name"))
    return rounded(metrics.bottleneck_report(samples).drop("weight"), digits=4)


@query("requests_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY")
def _(spark, sf):
    now = F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")
    return metrics.requests_retention(t.table(spark, sf, "events"), now).select("event_id")


@query("retain_days", """WITH e AS (SELECT *, CAST(ts AS DATE) AS d, ts < TIMESTAMP '2024-01-15 06:30:00' AS gone FROM events)
  SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS rows, sum(event_id)::BIGINT AS ids, (SELECT count(*) FROM e WHERE gone) AS deleted FROM e WHERE NOT gone GROUP BY d""")
def _(spark, sf):
    """Events stored by day, then the retention of 30 days as of mid-February applied to the stored table."""
    path = scratch_path(spark, "retained")
    t.table(spark, sf, "events").withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    deleted = retain_days(spark, path, F.lit("2024-02-14 06:30:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(30)), "ts")
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.lit(deleted).cast("bigint").alias("deleted"))


@query("match_freshness_stream", """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS m, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000 ORDER BY event_id) AS n FROM events),
  fresh AS (SELECT user_id, min(m) AS a FROM r GROUP BY 1
    UNION ALL SELECT user_id, (SELECT min(m) FROM r WHERE r.user_id = fresh.user_id AND r.m > a + 86400000) FROM fresh WHERE a IS NOT NULL)
  SELECT r.user_id::VARCHAR AS request_key, m AS created, NOT (n = 1 AND a IS NOT NULL) AS reused FROM r LEFT JOIN fresh ON fresh.user_id = r.user_id AND a = m""")
def _(spark, sf):
    """Each event as a request of its user whose result is valid for a day."""
    def build(events):
        timed = metrics.timed(events, "ts", "1 minute")
        return match_freshness_stream(timed.select(
            F.col("user_id").cast("string").alias("request_key"), F.unix_millis("ts").alias("created"), "ts"), 86_400, ordered=True)
    return streamed(spark, t.table(spark, sf, "events"), "freshness", build).where("request_key <> '-1'")


@query("match_freshness", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 300 SECOND")
def _(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return match_freshness(t.table(spark, sf, "events"), now, "ts").select("event_id")


TASK_UPDATE = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END"


@query("task_status_stream", f"""SELECT user_id::VARCHAR AS task_id, max_by({TASK_UPDATE}, event_id) AS status,
  max_by(props, event_id) FILTER (event_type = 'purchase') AS result FROM events GROUP BY 1""")
def _(spark, sf):
    """The events as updates of their user's task, as a stream in several batches; no task gets old enough to expire."""
    inbox, out = scratch_path(spark, "task-inbox"), scratch_path(spark, "task-status")
    events = t.table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    moment = F.col("ts").cast("timestamp")
    updates = stream.select(
        F.col("user_id").cast("string").alias("task_id"), F.expr(TASK_UPDATE).alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("result"),
        F.unix_millis(moment).alias("created"), F.col("event_id").alias("seq"), moment.alias("at"),
    ).withWatermark("at", "3650 days")
    told = task_status_stream(updates, expiry_seconds=10 * 365 * 86400)
    (
        told.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out))
        .option("checkpointLocation", scratch_path(spark, "task-state"))
        .outputMode("update").trigger(availableNow=True).start().awaitTermination()
    )
    stored = spark.read.schema(told.schema).parquet(out)
    return stored.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("result", "result_seq").alias("result"))


@query("task_latest_status", """WITH u AS (SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'purchase' THEN props END AS result FROM events)
  SELECT task_id, CASE WHEN min(ts) < TIMESTAMP '2024-01-01 03:00:00' - INTERVAL 3600 SECOND THEN 'expired' ELSE max_by(status, seq) END AS status, max_by(result, CASE WHEN result IS NOT NULL THEN seq END) AS result FROM u GROUP BY 1""")
def _(spark, sf):
    updates = t.table(spark, sf, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created"), F.col("ts").alias("updated"),
        F.expr("CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("result"))
    now = F.lit("2024-01-01 03:00:00").cast("timestamp_ntz")
    return task_latest_status(updates, now).select("task_id", "status", "result")
