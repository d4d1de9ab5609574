"""Windowed statistics over execution and stream logs.

Percentiles interpolate exactly; averages round half away from zero and percentiles half to even,
as the store's numeric and double types do. Time buckets are sparse: an empty minute has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def p(column: str, share: float) -> Column:
    return F.percentile(column, share)


def job_summary(stats: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """One row, also over no rows: counts by status, durations, latencies and retries; nulls are 0."""
    rows = stats.where(times.since(as_of, F.col("created_at"), minutes))
    status = lambda s: F.count_if(F.col("status") == s)
    latencies = []
    if "enqueue_latency_ms" in stats.columns:  # older logs have none
        latencies = [zero(F.round(F.avg("enqueue_latency_ms"), 1)).alias("avg_latency_ms"), zero(F.bround(p("enqueue_latency_ms", 0.95), 0)).alias("p95_latency_ms")]
    return rows.agg(
        F.count("*").alias("total"),
        status("success").alias("success"),
        status("failed").alias("failed"),
        status("dead_lettered").alias("dead_lettered"),
        zero(F.round(F.avg("duration_ms"), 1)).alias("avg_duration_ms"),
        zero(F.max("duration_ms")).alias("max_duration_ms"),
        zero(F.bround(p("duration_ms", 0.5), 0)).alias("p50_duration_ms"),
        zero(F.bround(p("duration_ms", 0.95), 0)).alias("p95_duration_ms"),
        zero(F.bround(p("duration_ms", 0.99), 0)).alias("p99_duration_ms"),
        *latencies,
        zero(F.round(F.avg("retry_count"), 2)).alias("avg_retries"),
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def per_minute(rows: DataFrame, at: str = "created_at") -> DataFrame:
    return rows.groupBy(F.date_trunc("minute", at).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


def duration_by_class(stats: DataFrame) -> DataFrame:
    return stats.groupBy("job_class").agg(F.round(F.avg("duration_ms"), 4).alias("avg_ms"))


def slowest_classes(stats: DataFrame, top: int = 10) -> DataFrame:
    out = stats.groupBy("job_class").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("max_ms"))
    return out.orderBy(F.desc("mean"), "job_class").limit(top).select("job_class", "n", F.round("mean", 0).alias("avg_ms"), "max_ms")


def latency(stats: DataFrame, *by: Column | str) -> DataFrame:
    """Average and 95th percentile of the latencies there are."""
    rows = stats.where("enqueue_latency_ms IS NOT NULL")
    return rows.groupBy(*by).agg(F.round(F.avg("enqueue_latency_ms"), 0).alias("avg_ms"), F.bround(p("enqueue_latency_ms", 0.95), 0).alias("p95_ms"), F.count("*").alias("n"))


def stream_summary(stats: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    broadcast = lambda c: F.when(F.col("event_type") == "broadcast", F.col(c))
    return stats.agg(
        kind("broadcast").alias("broadcasts"),
        kind("connect").alias("connects"),
        kind("disconnect").alias("disconnects"),
        F.greatest(kind("connect") - kind("disconnect"), F.lit(0).cast("long")).alias("active"),
        zero(F.round(F.avg(broadcast("fanout")), 1)).alias("avg_fanout"),
        zero(F.round(F.avg(broadcast("duration_ms")), 1)).alias("avg_ms"),
    )


def top_streams(stats: DataFrame, top: int = 10) -> DataFrame:
    rows = stats.where("event_type = 'broadcast'").groupBy("stream_name")
    out = rows.agg(F.count("*").alias("n"), F.round(F.avg("fanout"), 1).alias("avg_fanout"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))
    return out.orderBy(F.desc("n"), "stream_name").limit(top)


def stream_counters(stats: DataFrame) -> DataFrame:
    """By stream: broadcasts and connections that are open, never below 0."""
    delta = F.when(F.col("event_type") == "connect", 1).when(F.col("event_type") == "disconnect", -1).otherwise(0)
    return stats.groupBy("stream_name").agg(
        F.count_if(F.col("event_type") == "broadcast").alias("broadcasts"), F.greatest(F.sum(delta), F.lit(0).cast("long")).alias("active")
    )


#: What each event counts as. kind, metric, where its value comes from (a number, duration or a payload key), payload keys that are labels, and further labels.
EVENT_METRICS: dict[str, tuple[tuple[str, str, object, tuple[str, ...], dict[str, str]], ...]] = {
    "executor.execute": (("histogram", "job_duration_ms", "duration", ("queue", "job_class"), {}),),
    "job_completed": (("counter", "queue_job_count", 1, ("queue", "job_class"), {"status": "processed"}),),
    "job_failed": (("counter", "queue_job_count", 1, ("queue", "job_class"), {"status": "failed"}),),
    "job_dead_lettered": (("counter", "queue_job_count", 1, ("queue", "job_class"), {"status": "dead_lettered"}),),
    "event_processed": (("histogram", "event_duration_ms", "duration", ("handler", "routing_key"), {}), ("counter", "event_count", 1, ("handler", "routing_key"), {"status": "processed"})),
    "event_failed": (("counter", "event_count", 1, ("handler", "routing_key"), {"status": "failed"}),),
    "client.send_message": (("counter", "messages_sent", 1, ("queue",), {}),),
    "client.send_batch": (("counter", "messages_sent", "count", ("queue",), {}),),
    "client.read_batch": (("counter", "messages_read", "count", ("queue",), {}),),
    "stream.broadcast": (("counter", "stream_broadcast_count", 1, ("stream", "deferred"), {}),),
    "outbox.publish": (("counter", "outbox_published", 1, ("kind",), {}),),
    "recurring.enqueue": (("counter", "recurring_enqueued", 1, ("task", "class_name"), {}),),
    "worker.recycle": (("counter", "worker_recycled", 1, ("reason",), {"kind": "worker"}),),
    "consumer.recycle": (("counter", "worker_recycled", 1, ("reason",), {"kind": "consumer"}),),
    "client.pool": (("gauge", "pool_size", "size", ("hostname",), {}), ("gauge", "pool_available", "available", ("hostname",), {})),
}


def event_points(events: DataFrame) -> DataFrame:
    """kind, metric, labels, value and n by metric and set of labels, as a registry holds them: counters add up, gauges keep the last value, histograms sum and count.

    events: name, at, duration (ms) and payload (a map of strings); others are left out, and labels without a value.
    """

    def point(kind: str, metric: str, value: object, keys: tuple[str, ...], more: dict[str, str]) -> Column:
        labels = F.create_map(*[x for k in keys for x in (F.lit(k), F.col("payload")[k])], *[F.lit(x) for pair in more.items() for x in pair])
        amount = F.col("duration") if value == "duration" else F.lit(float(value)) if isinstance(value, int) else F.col("payload")[value].try_cast("double")
        amount = F.coalesce(amount, F.lit(1.0 if metric == "messages_sent" else 0.0)) if kind == "counter" else amount
        return F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.map_filter(labels, lambda _, v: v.isNotNull()).alias("labels"), amount.cast("double").alias("value"))

    points = F.lit(None)
    for name, own in EVENT_METRICS.items():
        points = F.when(F.col("name") == name, F.array(*[point(*x) for x in own])).otherwise(points)
    rows = events.select("at", F.explode(points).alias("p")).select("at", "p.*").where("value IS NOT NULL")
    rows = rows.withColumn("key", F.to_json(F.array_sort(F.map_entries("labels"))))  # maps don't group
    last = F.max_by("value", "at")
    out = rows.groupBy("kind", "metric", "key").agg(F.first("labels").alias("labels"), F.sum("value").alias("total"), last.alias("last"), F.count("*").alias("n"))
    return out.select("kind", "metric", "labels", F.when(F.col("kind") == "gauge", F.col("last")).otherwise(F.col("total")).alias("value"), "n")


def consumer_rows(handled: DataFrame) -> DataFrame:
    """Log rows of events that consumers handled: one class for all, no latency, a first read is no retry."""
    return handled.select(
        F.lit("EventConsumer").alias("job_class"), "queue_name", "status", F.round("elapsed_ms", 0).cast("long").alias("duration_ms"), F.lit(None).cast("long").alias("enqueue_latency_ms"), F.greatest(F.col("read_ct") - 1, F.lit(0)).alias("retry_count")
    )


def write_stats(rows: DataFrame, path: str) -> None:
    """Appends log rows to the statistics under path, in one write for all."""
    rows.write.mode("append").parquet(path)


def stream_stats_to(rows: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", files: int | None = None):
    """Appends a stream of log rows to path: what has come in goes out every few seconds in one write; progress is kept, so no row is written twice."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def insights(stats: DataFrame, streams: DataFrame, as_of: str, minutes: int) -> dict[str, DataFrame]:
    """The reports of the overview: summary, throughput, counts, slowest classes, live streams, and latencies where the log has them."""
    recent = stats.where(times.since(as_of, F.col("created_at"), minutes))
    out = {"summary": job_summary(stats, as_of, minutes), "throughput": per_minute(recent), "status_counts": counts_by(recent, "status"), "slowest": slowest_classes(recent)}
    if "enqueue_latency_ms" in stats.columns:
        out["latency_trend"] = latency(recent, F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("minute"))
        out["latency_by_queue"] = latency(recent, "queue_name")
    return out | {"live_streams": stream_counters(streams)}


def metric_points(stats: DataFrame) -> DataFrame:
    """Counters and histogram sums by metric and tag, as a metrics backend holds them."""
    jobs = stats.groupBy(F.lit("jobs_total").alias("metric"), F.concat(F.lit("status:"), "status").alias("tag")).agg(F.count("*").cast("double").alias("value"))
    total = stats.groupBy(F.lit("job_duration_ms_sum").alias("metric"), F.concat(F.lit("class:"), "job_class").alias("tag")).agg(F.sum("duration_ms").cast("double").alias("value"))
    return jobs.unionByName(total)


def distributions(stats: DataFrame) -> DataFrame:
    """Per minute and status: count, mean and upper percentiles of the duration."""
    return stats.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), "status").agg(
        F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.round(p("duration_ms", 0.95), 4).alias("p95_ms"), F.round(p("duration_ms", 0.99), 4).alias("p99_ms")
    )


def byte_distributions(frames: DataFrame, by: str, payload: str) -> DataFrame:
    """By stream: frames, and mean and upper percentile of their bytes."""
    rows = frames.withColumn("bytes", F.octet_length(payload))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("bytes"), 4).alias("mean_bytes"), F.round(p("bytes", 0.95), 4).alias("p95_bytes"))


def stat_rows(runs: DataFrame) -> DataFrame:
    """Log rows of finished runs: latency is never negative, a first read is no retry."""
    return runs.select(
        "msg_id",
        F.round("elapsed_ms", 0).cast("long").alias("duration_ms"),
        F.greatest(F.lit(0).cast("long"), (times.micros(F.col("started_at")) - times.micros(F.col("enqueued_at"))).cast("long") / 1000).cast("long").alias("enqueue_latency_ms"),
        F.greatest(F.col("read_ct") - 1, F.lit(0)).alias("retry_count"),
    )
