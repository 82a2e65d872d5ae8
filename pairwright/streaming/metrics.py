"""Operational metrics: parsing, 10-second roll-ups and derived events.

Every function takes a batch or a streaming DataFrame. On streams ``watermark`` bounds the
state; on batch input it has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright import fixed_values as fv
from pairwright.functions.scores import duration_category, query_duration_category
from pairwright.functions.text import let


def timed(events: DataFrame, time: str, watermark: str | None) -> DataFrame:
    """Events with a watermark on streams; plain wall-clock times get the session's zone first.

    None leaves a watermark that the stream already has.
    """
    if not events.isStreaming or watermark is None:
        return events
    if events.schema[time].dataType.simpleString() == "timestamp_ntz":
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, watermark)


def once(events: DataFrame, key: str, time: str = "ts", watermark: str = "1 minute") -> DataFrame:
    """Events without retries: the first row of each ``key``.

    On a stream the key is remembered until the watermark passes, so a retry has to come within it; one that comes
    later is dropped as late by the windows behind. Give those ``watermark=None``.
    """
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return timed(events, time, watermark).dropDuplicatesWithinWatermark([key])


def parse_statsd(lines: DataFrame, value: str = "value") -> DataFrame:
    """``name:value|type|@rate|#k:v,...`` to columns; malformed lines are dropped.

    The name ends at the first colon; rate and tags are read from the whole rest of the line,
    as the line format says.
    """
    line = F.col(value)
    name = F.regexp_extract(line, r"^([^:]*):", 1)
    rest = F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1)
    parts = F.split(rest, r"\|")
    number = F.get(parts, F.lit(0)).try_cast("double")
    kind = F.get(F.split(F.get(parts, F.lit(1)), ":"), F.lit(0))
    extra = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    rates = F.filter(
        F.transform(F.filter(extra, lambda p: p.startswith("@")),
                    lambda p: F.substring(p, F.lit(2), F.length(p)).try_cast("double")),
        lambda r: r.isNotNull(),
    )
    pairs = F.flatten(F.transform(
        F.filter(extra, lambda p: p.startswith("#")),
        lambda p: F.split(F.substring(p, F.lit(2), F.length(p)), ","),
    ))
    good = F.filter(F.transform(pairs, lambda p: F.split(p, ":")), lambda kv: F.size(kv) == 2)
    # a repeated tag keeps its last value
    tags = let(good, lambda found: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(found, lambda kv: kv[0])),
        lambda k: F.struct(k, F.element_at(F.filter(found, lambda kv: kv[0] == k), -1)[1]))))
    parsed = lines.withColumns({
        "name": name, "metric_value": number, "type": kind,
        "sample_rate": F.coalesce(F.try_element_at(rates, F.lit(-1)), F.lit(1.0)), "tags": tags,
    })
    known = F.col("type").isin("c", "g", "ms", "h")
    return parsed.where(line.contains(":") & F.col("metric_value").isNotNull() & known)


def statsd_rollup(
    metrics: DataFrame, time: str = "ts", by_tags: bool = False, seconds: int = fv.FLUSH_SECONDS,
    watermark: str | None = "1 minute",
) -> DataFrame:
    """Per flush window and metric: counter sum, last gauge, timer and histogram summary.

    Counters, timers and histograms start new in every window. A gauge row holds the last
    value inside its window; ``carry_gauges`` tells how long it stays in force.
    """
    source = metrics.withColumn("_tags", F.to_json("tags")) if by_tags else metrics
    keys = ["name", "type"] + (["_tags"] if by_tags else [])
    value, kind = F.col("metric_value"), F.col("type")
    spread = kind.isin("ms", "h")
    rolled = (
        timed(source, time, watermark)
        .groupBy(F.window(time, f"{seconds} seconds").alias("window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum(F.when(kind == "c", value / F.col("sample_rate"))).alias("counter"),
            F.max_by(F.when(kind == "g", value), F.when(kind == "g", F.col(time))).alias("gauge"),
            F.min(F.when(spread, value)).alias("min"),
            F.avg(F.when(spread, value)).alias("avg"),
            F.max(F.when(spread, value)).alias("max"),
        )
    )
    named = rolled.withColumnRenamed("_tags", "tags") if by_tags else rolled
    return named.withColumn("window_start", F.col("window.start")).drop("window")


def carry_gauges(rolled: DataFrame) -> DataFrame:
    """Gauge rows of a roll-up with the window start until which each value is kept.

    A gauge keeps its value over windows without one; ``valid_until`` is null for the value
    in force. Batch only; ``streaming.state.carry_gauges_stream`` is the form for streams.
    """
    gauges = rolled.where(F.col("type") == "g")
    keys = ["name"] + (["tags"] if "tags" in rolled.columns else [])
    following = Window.partitionBy(*keys).orderBy("window_start")
    return gauges.select(*keys, "gauge", "window_start").withColumn(
        "valid_until", F.lead("window_start").over(following)
    )


def http_request_rollup(
    requests: DataFrame, time: str = "ts", seconds: int = fv.FLUSH_SECONDS,
    watermark: str | None = "1 minute", slow_ms: float = fv.SLOW_REQUEST_MS,
) -> DataFrame:
    """Per window, method, route and status range: counts, errors, durations, sizes, slow ones.

    Needs ``method, route, status_code, duration_ms, request_size, response_size, error_type``.
    """
    status = F.concat(F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx"))
    return (
        timed(requests, time, watermark)
        .groupBy(F.window(time, f"{seconds} seconds").alias("window"), "method", "route",
                 status.alias("status_range"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count("error_type").alias("errors"),
            F.min("duration_ms").alias("min_ms"), F.avg("duration_ms").alias("avg_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.sum(F.when(F.col("duration_ms") > slow_ms, 1).otherwise(0)).alias("slow"),
            F.max("request_size").alias("max_request_size"),
            F.max("response_size").alias("max_response_size"),
        )
        .withColumn("window_start", F.col("window.start")).drop("window")
    )


def _derived(metric: Column, kind: str, value: Column) -> Column:
    return F.struct(metric.alias("metric"), F.lit(kind).alias("type"), value.cast("double").alias("value"))


def slow_operation_events(
    metrics: DataFrame, name: str = "name", value: str = "value", database: bool = False,
    threshold_ms: float | None = None,
) -> DataFrame:
    """Derived rows of every duration: slow counter, exact slow time and distribution.

    Only ``*.duration`` metrics above the threshold are slow; ``http.*`` metrics always get a
    distribution row. The database variant reads ``name`` as the query's name.
    """
    took = F.col(value)
    if database:
        limit = fv.SLOW_QUERY_MS if threshold_ms is None else threshold_ms
        slow = took > limit
        rows = F.array_compact(F.array(
            _derived(F.lit("db.query.duration_distribution"), "h", took),
            F.when(slow, _derived(
                F.concat(F.lit("db.query.slow."), F.col(name), F.lit(".duration_ms")), "g", took)),
            F.when(slow, _derived(F.lit("db.query.slow"), "c", F.lit(1.0))),
        ))
        category = query_duration_category(took)
    else:
        limit = fv.SLOW_REQUEST_MS if threshold_ms is None else threshold_ms
        slow = F.col(name).endswith(".duration") & (took > limit)
        base = F.replace(F.col(name), F.lit(".duration"), F.lit(""))
        spread = F.concat(base, F.lit(".duration_distribution"))
        rows = F.array_compact(F.array(
            F.when(slow, _derived(F.concat(base, F.lit(".slow")), "c", F.lit(1.0))),
            F.when(slow, _derived(F.concat(base, F.lit(".slow_duration_ms")), "g", took)),
            F.when(slow, _derived(spread, "h", took)),
            F.when(F.col(name).startswith("http."), _derived(spread, "h", took)),
        ))
        category = duration_category(took)
    kept = [c for c in metrics.columns if c not in (name, value)]
    return metrics.withColumn("_row", F.explode(rows)).select(
        *kept, "_row.metric", "_row.type", "_row.value", category.alias("duration_category"),
        slow.alias("is_slow"),
    )


def operation_outcomes(
    events: DataFrame, operation: str = "operation", error_type: str = "error_type",
    duration: str = "duration_ms", time: str | None = None, seconds: int = 60,
    watermark: str | None = "1 minute",
) -> DataFrame:
    """Calls and durations per operation, status and error type; windowed when ``time`` is set."""
    status = F.when(F.col(error_type).isNull(), "success").otherwise("error")
    keys: list = [F.col(operation), status.alias("status"), F.col(error_type)]
    source = events
    if time:
        source = timed(events, time, watermark)
        keys.insert(0, F.window(time, f"{seconds} seconds").alias("window"))
    return source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.min(duration).alias("min_ms"),
        F.avg(duration).alias("avg_ms"), F.max(duration).alias("max_ms"),
    )


def bottleneck_report(samples: DataFrame, name: str = "name", value: str = "value",
                      order: str = "seq", kind: str = "section") -> DataFrame:
    """Findings of a metric dump in order of weight: ``finding, metric, value, verdict``.

    ``samples`` are parsed dump rows (see ``scan_statsd_log``). The last value of each
    database metric above 500 ms, each algorithm metric above 1000 ms and a response size
    above 10000 count; slow request totals are listed without a verdict.
    """
    last = samples.groupBy(name).agg(
        F.max_by(value, order).alias("_last"), F.sum(value).alias("_total"),
        F.max_by(F.when(F.col(kind) == "gauge", F.col(value)),
                 F.when(F.col(kind) == "gauge", F.col(order))).alias("_gauge"),
    )
    metric = F.col(name)
    query = metric.contains("db.query") & metric.endswith(".duration")
    findings = F.array_compact(F.array(
        F.when(query & (F.col("_last") > fv.SLOW_QUERY_MS),
               F.struct(F.lit(1).alias("weight"), F.lit("database").alias("finding"),
                        F.col("_last").alias("value"))),
        F.when(metric.contains("algorithm") & (F.col("_last") > fv.SLOW_ALGORITHM_MS),
               F.struct(F.lit(2).alias("weight"), F.lit("algorithm").alias("finding"),
                        F.col("_last").alias("value"))),
        F.when((metric == "http.response.size") & (F.col("_gauge") > fv.LARGE_RESPONSE),
               F.struct(F.lit(3).alias("weight"), F.lit("response_size").alias("finding"),
                        F.col("_gauge").alias("value"))),
        F.when(metric.endswith("http.requests.slow"),
               F.struct(F.lit(4).alias("weight"), F.lit("slow_requests").alias("finding"),
                        F.col("_total").alias("value"))),
    ))
    rows = last.withColumn("_f", F.explode(findings)).select(
        "_f.weight", "_f.finding", metric.alias("metric"), F.col("_f.value").alias("value")
    )
    verdict = rows.where(F.col("weight") < 4).agg(F.min_by("finding", "weight").alias("v")).scalar()
    return rows.withColumn("verdict", F.coalesce(verdict, F.lit("none"))).orderBy(
        "weight", F.desc("value"), "metric"
    )


def requests_retention(requests: DataFrame, as_of: Column, time: str = "ts",
                       days: int = fv.REQUEST_RETENTION_DAYS) -> DataFrame:
    """Requests of the last ``days``; on a stream, state older than that is dropped as well."""
    return timed(requests, time, f"{days} days").where(F.col(time) >= as_of - F.make_dt_interval(F.lit(days)))
