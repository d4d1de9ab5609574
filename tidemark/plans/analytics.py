"""Queries over metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import metrics, stats
from tidemark.plans.registry import query
from tidemark.sources import sinks
from tidemark.sources.views import NOW, Source

_T = f"TIMESTAMP '{NOW}'"
_AGE = lambda ts: f"CAST(round_even(epoch({_T} - {ts}), 0) AS BIGINT)"
MONTH = 45_000  # minutes: the logs' whole span
DAY = 2_000

_METRICS = f"""SELECT queue_name, count(*) AS length, count(*) FILTER (WHERE vt <= {_T}) AS visible, count(*) FILTER (WHERE vt <= {_T} AND read_ct = 0) AS visible_unread,
    {_AGE('max(enqueued_at)')} AS newest_age_s, {_AGE('min(enqueued_at)')} AS oldest_age_s, {_AGE(f'min(vt) FILTER (WHERE vt <= {_T})')} AS oldest_claimable_s,
    max(read_ct) AS max_read_ct, max(msg_id) AS total_messages, count(*) - count(*) FILTER (WHERE vt <= {_T}) AS parked FROM queue_messages GROUP BY queue_name"""


@query(_METRICS)
def queue_metrics(s: Source) -> DataFrame:
    return metrics.queue_metrics(s.queue_messages, NOW)


@query(f"SELECT c.queue_name, coalesce(m.length, 0) AS length, m.oldest_age_s FROM (VALUES ('mq_default'), ('mq_empty')) c(queue_name) LEFT JOIN ({_METRICS}) m ON m.queue_name = c.queue_name")
def queue_metrics_of_catalog(s: Source) -> DataFrame:
    catalog = s.spark.createDataFrame([("mq_default",), ("mq_empty",)], "queue_name string")
    return metrics.queue_metrics(s.queue_messages, NOW, catalog).select("queue_name", "length", "oldest_age_s")


@query(f"""SELECT count(*) AS queues, CAST(sum(length) AS BIGINT) AS total_depth, CAST(sum(visible) AS BIGINT) AS total_visible,
    CAST(coalesce(sum(length) FILTER (WHERE queue_name LIKE '%dlq'), 0) AS BIGINT) AS dlq_depth, count(*) FILTER (WHERE queue_name LIKE '%dlq') AS dlq_queues FROM ({_METRICS}) m""")
def dashboard(s: Source) -> DataFrame:
    return metrics.dashboard(metrics.queue_metrics(s.queue_messages, NOW))


@query(f"SELECT m.queue_name, m.length, coalesce(s.paused, false) AS paused FROM ({_METRICS}) m LEFT JOIN queue_states s ON s.queue_name = regexp_replace(m.queue_name, '^mq_', '')")
def paused_queues(s: Source) -> DataFrame:
    return metrics.paused_flags(metrics.queue_metrics(s.queue_messages, NOW), s.queue_states).select("queue_name", "length", "paused")


_SINCE = f"created_at >= {_T} - INTERVAL {DAY} MINUTE"


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'dead_lettered') AS dead_lettered,
    coalesce(round(avg(duration_ms), 1), 0) AS avg_duration_ms, coalesce(max(duration_ms), 0) AS max_duration_ms,
    coalesce(round_even(quantile_cont(duration_ms, 0.5), 0), 0) AS p50_duration_ms, coalesce(round_even(quantile_cont(duration_ms, 0.95), 0), 0) AS p95_duration_ms,
    coalesce(round_even(quantile_cont(duration_ms, 0.99), 0), 0) AS p99_duration_ms, coalesce(round(avg(enqueue_latency_ms), 1), 0) AS avg_latency_ms,
    coalesce(round_even(quantile_cont(enqueue_latency_ms, 0.95), 0), 0) AS p95_latency_ms, coalesce(round(avg(retry_count), 2), 0) AS avg_retries FROM job_stats WHERE {_SINCE}""")
def job_summary(s: Source) -> DataFrame:
    return stats.job_summary(s.job_stats, NOW, DAY)


@query("SELECT status, count(*) AS n FROM job_stats GROUP BY status")
def status_counts(s: Source) -> DataFrame:
    return stats.counts_by(s.job_stats, "status")


@query(f"SELECT date_trunc('minute', created_at) AS minute, count(*) AS n FROM job_stats WHERE {_SINCE} GROUP BY 1")
def throughput(s: Source) -> DataFrame:
    return stats.per_minute(s.job_stats.where(times.since(NOW, F.col("created_at"), DAY)))


@query("SELECT job_class, round(avg(duration_ms), 4) AS avg_ms FROM job_stats GROUP BY job_class")
def duration_by_class(s: Source) -> DataFrame:
    return stats.duration_by_class(s.job_stats)


@query("SELECT job_class, count(*) AS n, round(avg(duration_ms), 0) AS avg_ms, max(duration_ms) AS max_ms FROM job_stats GROUP BY job_class ORDER BY avg(duration_ms) DESC, job_class LIMIT 3")
def slowest_classes(s: Source) -> DataFrame:
    return stats.slowest_classes(s.job_stats, 3)


@query(f"SELECT date_trunc('minute', created_at) AS minute, round(avg(enqueue_latency_ms), 0) AS avg_ms, round_even(quantile_cont(enqueue_latency_ms, 0.95), 0) AS p95_ms, count(*) AS n FROM job_stats WHERE enqueue_latency_ms IS NOT NULL AND {_SINCE} GROUP BY 1")
def latency_trend(s: Source) -> DataFrame:
    rows = s.job_stats.where(times.since(NOW, F.col("created_at"), DAY))
    return stats.latency(rows, F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("minute"))


@query("SELECT queue_name, round(avg(enqueue_latency_ms), 0) AS avg_ms, round_even(quantile_cont(enqueue_latency_ms, 0.95), 0) AS p95_ms, count(*) AS n FROM job_stats WHERE enqueue_latency_ms IS NOT NULL GROUP BY 1")
def latency_by_queue(s: Source) -> DataFrame:
    return stats.latency(s.job_stats, "queue_name")


@query("""SELECT count(*) FILTER (WHERE event_type = 'broadcast') AS broadcasts, count(*) FILTER (WHERE event_type = 'connect') AS connects, count(*) FILTER (WHERE event_type = 'disconnect') AS disconnects,
    greatest(count(*) FILTER (WHERE event_type = 'connect') - count(*) FILTER (WHERE event_type = 'disconnect'), 0) AS active,
    coalesce(round(avg(fanout) FILTER (WHERE event_type = 'broadcast'), 1), 0) AS avg_fanout, coalesce(round(avg(duration_ms) FILTER (WHERE event_type = 'broadcast'), 1), 0) AS avg_ms FROM stream_stats""")
def stream_summary(s: Source) -> DataFrame:
    return stats.stream_summary(s.stream_stats)


@query("SELECT stream_name, count(*) AS n, round(avg(fanout), 1) AS avg_fanout, round(avg(duration_ms), 1) AS avg_ms FROM stream_stats WHERE event_type = 'broadcast' GROUP BY 1 ORDER BY n DESC, stream_name LIMIT 10")
def top_streams(s: Source) -> DataFrame:
    return stats.top_streams(s.stream_stats)


@query(f"SELECT date_trunc('minute', created_at) AS minute, count(*) AS n FROM stream_stats WHERE event_type = 'broadcast' AND {_SINCE} GROUP BY 1")
def stream_throughput(s: Source) -> DataFrame:
    return stats.per_minute(s.stream_stats.where("event_type = 'broadcast'").where(times.since(NOW, F.col("created_at"), DAY)))


_COUNTERS = """SELECT stream_name, count(*) FILTER (WHERE event_type = 'broadcast') AS broadcasts,
    greatest(CAST(sum(CASE event_type WHEN 'connect' THEN 1 WHEN 'disconnect' THEN -1 ELSE 0 END) AS BIGINT), 0) AS active FROM stream_stats GROUP BY stream_name"""


@query(_COUNTERS)
def stream_counters(s: Source) -> DataFrame:
    return stats.stream_counters(s.stream_stats)


@query(f"SELECT CAST(sum(broadcasts) AS BIGINT) AS broadcasts, CAST(sum(active) AS BIGINT) AS active, count(*) AS streams FROM ({_COUNTERS}) c")
def stream_totals(s: Source) -> DataFrame:
    return stats.stream_counters(s.stream_stats).agg(F.sum("broadcasts").alias("broadcasts"), F.sum("active").alias("active"), F.count("*").alias("streams"))


@query("""SELECT 'jobs_total' AS metric, 'status:' || status AS tag, CAST(count(*) AS DOUBLE) AS value FROM job_stats GROUP BY status
    UNION ALL SELECT 'job_duration_ms_sum', 'class:' || job_class, CAST(sum(duration_ms) AS DOUBLE) FROM job_stats GROUP BY job_class""")
def metric_points(s: Source) -> DataFrame:
    return stats.metric_points(s.job_stats)


@query("SELECT date_trunc('hour', created_at) AS hour, status, count(*) AS n, round(avg(duration_ms), 4) AS mean_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 4) AS p99_ms FROM job_stats GROUP BY 1, 2")
def distributions(s: Source) -> DataFrame:
    return stats.distributions(s.job_stats)


@query("SELECT event_id AS msg_id, CAST(round(value, 0) AS BIGINT) AS duration_ms, CAST(greatest(0, 1500 - (event_id % 5) * 500) AS BIGINT) AS enqueue_latency_ms, greatest(event_id % 3 - 1, 0) AS retry_count FROM events")
def stat_rows(s: Source) -> DataFrame:
    started = F.col("ts") + F.expr("make_dt_interval(0, 0, 0, (1500 - (event_id % 5) * 500) / 1000.0)")
    runs = s.events.select(F.col("event_id").alias("msg_id"), F.col("value").alias("elapsed_ms"), F.col("ts").alias("enqueued_at"), started.alias("started_at"), (F.col("event_id") % 3).alias("read_ct"))
    return stats.stat_rows(runs)


_TABLES = "SELECT queue_name, count(*) FILTER (WHERE read_ct < 5) AS live, count(*) FILTER (WHERE read_ct >= 5) AS dead FROM queue_messages GROUP BY queue_name"


def _tables(s: Source) -> DataFrame:
    return s.queue_messages.groupBy("queue_name").agg(F.count_if(F.col("read_ct") < 5).alias("live"), F.count_if(F.col("read_ct") >= 5).alias("dead"))


@query(f"SELECT CAST(sum(dead) AS BIGINT) AS dead, CAST(sum(live) AS BIGINT) AS live, max(round(dead / (dead + live), 4)) AS worst_bloat, count(*) FILTER (WHERE round(dead / (dead + live), 4) > 0.1) AS bloated, max(CASE WHEN queue_name <> 'mq_low' THEN live % 1000 END) AS oldest_vacuum_s FROM ({_TABLES}) t")
def table_health(s: Source) -> DataFrame:
    """Health over all tables, one of which was never vacuumed."""
    return metrics.table_health(_tables(s).withColumn("last_vacuum_s", F.when(F.col("queue_name") != "mq_low", F.col("live") % 1000)))


@query(f"SELECT queue_name, live, dead FROM ({_TABLES}) t WHERE dead / (dead + live) > 0.28 ORDER BY dead DESC")
def vacuum_candidates(s: Source) -> DataFrame:
    return metrics.vacuum_candidates(_tables(s), 0.28)


_STATUS = f"""SELECT id, kind, CASE WHEN epoch({_T} - last_heartbeat_at) > 90000 THEN 'stale' WHEN epoch({_T} - loop_tick_at) > (CASE kind WHEN 'worker' THEN 60000 ELSE 86500 END) THEN 'stalled' ELSE 'healthy' END AS status FROM processes"""


@query(_STATUS)
def process_status(s: Source) -> DataFrame:
    return metrics.process_status(s.processes, NOW, 90_000, {"worker": 60_000}, 86_500).select("id", "kind", "status")


@query(f"SELECT hostname, coalesce(min(least(epoch({_T} - last_heartbeat_at), epoch({_T} - loop_tick_at))) > 86700, false) AS stalled FROM processes GROUP BY hostname")
def watchdog(s: Source) -> DataFrame:
    age = lambda c: times.seconds_between(times.moment(NOW), F.col(c))
    rows = s.processes.groupBy("hostname").agg(F.min(F.least(age("last_heartbeat_at"), age("loop_tick_at"))).alias("age"))
    return rows.select("hostname", metrics.watchdog([F.col("age")], 86_700).alias("stalled"))


_STATE = f"""SELECT m.*, coalesce(s.paused, false) AS paused, ends_with(m.queue_name, '_dlq') AS dead, m.queue_name IN (SELECT queue_name FROM stream_queues) AS stream FROM ({_METRICS}) m
    LEFT JOIN queue_states s ON 'mq_' || s.queue_name = m.queue_name"""


def _verdict_sql(scene: str, drained: str, processes: str, oldest: str, unregistered: str) -> str:
    names_ = lambda cond: f"array_to_string(list(queue_name ORDER BY queue_name) FILTER (WHERE {cond}), ', ')"
    active, undrained = "NOT dead AND NOT stream AND visible > 0 AND NOT paused", f"NOT ({drained})"
    unclaimed = f"{active} AND ({drained}) AND visible_unread > 0"
    held = "NOT dead AND NOT stream AND visible > 0 AND paused"
    return f"""SELECT '{scene}' AS scene, CASE WHEN len(a) > 0 THEN 'STALLED' WHEN len(b) > 0 THEN 'DEGRADED' ELSE 'OK' END AS status, array_to_string(list_concat(a, b), '; ') AS reasons, total_visible, total_depth, workers FROM (
    SELECT list_filter([CASE WHEN stalled > 0 AND active > 0 THEN stalled || ' worker(s) stalled (heart-beating but claim loop not advancing) while ' || active || ' queue(s) have visible backlog: ' || active_names
        WHEN drainers > 0 AND unclaimed > 0 THEN unclaimed || ' queue(s) have visible messages with read_ct=0 (never claimed) while ' || drainers || ' draining process(es) are alive: ' || unclaimed_names END], lambda x: x IS NOT NULL) AS a,
    list_filter([CASE WHEN stale > 0 THEN stale || ' process(es) stale (no recent heartbeat)' END, CASE WHEN held > 0 THEN held || ' paused queue(s) holding a backlog: ' || held_names END,
        CASE WHEN undrained > 0 THEN undrained || ' queue(s) hold messages but no capsule is configured to drain them: ' || undrained_names END, CASE WHEN dead > 0 THEN dead || ' dead-letter queue(s) hold messages' END,
        CASE WHEN {oldest} > 300 THEN 'oldest open transaction is ' || {oldest} || 's old (MVCC horizon pinning risk)' END,
        CASE WHEN {unregistered} > 0 THEN {unregistered} || ' unregistered stream queue(s) detected (dormant pre-registry durable streams)' END], lambda x: x IS NOT NULL) AS b, * FROM
    (SELECT count(*) FILTER (WHERE {active}) AS active, {names_(active)} AS active_names, count(*) FILTER (WHERE {held}) AS held, {names_(held)} AS held_names, count(*) FILTER (WHERE {unclaimed}) AS unclaimed, {names_(unclaimed)} AS unclaimed_names,
        count(*) FILTER (WHERE {active} AND {undrained}) AS undrained, {names_(f"{active} AND {undrained}")} AS undrained_names, count(*) FILTER (WHERE dead AND length > 0) AS dead,
        sum(visible) FILTER (WHERE NOT dead AND NOT stream) AS total_visible, sum(length) FILTER (WHERE NOT dead AND NOT stream) AS total_depth FROM ({_STATE}) q) l,
    (SELECT count(*) FILTER (WHERE kind = 'worker') AS workers, count(*) FILTER (WHERE kind = 'worker' AND status = 'stalled') AS stalled, count(*) FILTER (WHERE kind IN ('worker', 'consumer') AND status IN ('healthy', 'stalled')) AS drainers,
        count(*) FILTER (WHERE status = 'stale') AS stale FROM ({_STATUS}) p WHERE {processes}) c) r"""


_SCENES = {
    "as is": ("true", "true", "NULL", "0"),
    "no stalled worker": ("true", "NOT (kind = 'worker' AND status = 'stalled')", "301", "0"),
    "undrained": ("queue_name = 'mq_default'", "status = 'healthy' AND kind = 'dispatcher'", "300", "4"),
    "nobody": ("false", "false", "NULL", "0"),
}


@query(" UNION ALL ".join(_verdict_sql(scene, *args) for scene, args in _SCENES.items()))
def health_verdict(s: Source) -> DataFrame:
    """The verdict in several scenes: which queues are drained, which processes live, what the server says."""
    queues = metrics.paused_flags(metrics.queue_metrics(s.queue_messages, NOW), s.queue_states)
    crew = metrics.process_status(s.processes, NOW, 90_000, {"worker": 60_000}, 86_500)
    out = None
    for scene, (drained, processes, oldest, unregistered) in _SCENES.items():
        claimed = None if drained == "true" else queues.where(drained).select("queue_name")
        one = metrics.verdict(queues, crew.where(processes), s.stream_queues, claimed, F.lit(None if oldest == "NULL" else int(oldest)).cast("long"), F.lit(int(unregistered)))
        one = one.select(F.lit(scene).alias("scene"), "status", F.array_join("reasons", "; ").alias("reasons"), "total_visible", "total_depth", "workers")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT queue_name, day, n, round(coalesce(CAST(n - lag(n) OVER w AS DOUBLE) / epoch(day - lag(day) OVER w), 0), 1) AS rate FROM (SELECT queue_name, date_trunc('day', enqueued_at) AS day, 100000 * count(*) AS n FROM queue_messages GROUP BY 1, 2) d WINDOW w AS (PARTITION BY queue_name ORDER BY day)")
def snapshot_rates(s: Source) -> DataFrame:
    days = s.queue_messages.groupBy("queue_name", F.date_trunc("day", "enqueued_at").cast("timestamp_ntz").alias("day")).agg((F.count("*") * 100_000).alias("n"))
    return metrics.snapshot_rates(days, "queue_name", "day", "n")


@query(f"SELECT stream_name, broadcasts, active FROM ({_COUNTERS}) c ORDER BY broadcasts DESC, stream_name LIMIT 10")
def live_streams(s: Source) -> DataFrame:
    """Streams by their broadcasts, the busiest first."""
    return stats.stream_counters(s.stream_stats).orderBy(F.desc("broadcasts"), "stream_name").limit(10)


@query("SELECT 'EventConsumer' AS job_class, queue_name, CASE WHEN msg_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CAST(round(msg_id % 700 / 7.0, 0) AS BIGINT) AS duration_ms, CAST(NULL AS BIGINT) AS enqueue_latency_ms, greatest(read_ct - 1, 0) AS retry_count FROM queue_messages")
def consumer_stat_rows(s: Source) -> DataFrame:
    rows = s.queue_messages.select("queue_name", F.when(F.col("msg_id") % 5 == 0, "failed").otherwise("success").alias("status"), (F.col("msg_id") % 700 / 7.0).alias("elapsed_ms"), "read_ct")
    return stats.consumer_rows(rows)


def _notices(s: Source) -> DataFrame:
    names = F.array(*map(F.lit, stats.EVENT_METRICS), F.lit("other"))
    user, at = F.col("user_id").cast("string"), F.col("event_id")
    payload = F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate([
        "queue", F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")), "job_class", F.when(F.col("user_id") % 2 == 0, "J"), "handler", F.lit('H"1'), "count", (at % 4).cast("string"), "stream", F.lit("s"), "deferred", F.lit("false"),
        "kind", F.lit("job"), "task", F.lit("t"), "reason", F.lit("age"), "hostname", F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")), "size", (at % 9).cast("string"), "available", user])])
    return s.events.select(F.element_at(names, (at % 16 + 1).cast("int")).alias("name"), at.alias("at"), F.col("value").alias("duration"), payload.alias("payload"))


_NAMES_SQL = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(stats.EVENT_METRICS)) + " ELSE 'other' END"
_QUEUE_TAGS = "'job_class=' || CASE WHEN user_id % 2 = 0 THEN 'J' ELSE '' END || ',queue=q' || CAST(user_id % 3 AS VARCHAR)"


@query(f"""WITH n AS (SELECT *, {_NAMES_SQL} AS name FROM events), p AS (
    SELECT 'histogram' AS kind, 'job_duration_ms' AS metric, {_QUEUE_TAGS} AS tags, value, event_id FROM n WHERE name = 'executor.execute'
    UNION ALL SELECT 'counter', 'queue_job_count', {_QUEUE_TAGS} || ',status=' || CASE name WHEN 'job_completed' THEN 'processed' WHEN 'job_failed' THEN 'failed' ELSE 'dead_lettered' END, 1, event_id FROM n WHERE name IN ('job_completed', 'job_failed', 'job_dead_lettered')
    UNION ALL SELECT 'histogram', 'event_duration_ms', 'handler=H"1', value, event_id FROM n WHERE name = 'event_processed'
    UNION ALL SELECT 'counter', 'event_count', 'handler=H"1,status=' || replace(name, 'event_', ''), 1, event_id FROM n WHERE name IN ('event_processed', 'event_failed')
    UNION ALL SELECT 'counter', 'messages_sent', 'queue=q' || CAST(user_id % 3 AS VARCHAR), CASE name WHEN 'client.send_batch' THEN event_id % 4 ELSE 1 END, event_id FROM n WHERE name IN ('client.send_message', 'client.send_batch')
    UNION ALL SELECT 'counter', 'messages_read', 'queue=q' || CAST(user_id % 3 AS VARCHAR), event_id % 4, event_id FROM n WHERE name = 'client.read_batch'
    UNION ALL SELECT 'counter', 'stream_broadcast_count', 'deferred=false,stream=s', 1, event_id FROM n WHERE name = 'stream.broadcast'
    UNION ALL SELECT 'counter', 'outbox_published', 'kind=job', 1, event_id FROM n WHERE name = 'outbox.publish'
    UNION ALL SELECT 'counter', 'recurring_enqueued', 'task=t', 1, event_id FROM n WHERE name = 'recurring.enqueue'
    UNION ALL SELECT 'counter', 'worker_recycled', 'kind=' || replace(name, '.recycle', '') || ',reason=age', 1, event_id FROM n WHERE name IN ('worker.recycle', 'consumer.recycle')
    UNION ALL SELECT 'gauge', 'pool_size', 'hostname=h' || CAST(user_id % 2 AS VARCHAR), event_id % 9, event_id FROM n WHERE name = 'client.pool'
    UNION ALL SELECT 'gauge', 'pool_available', 'hostname=h' || CAST(user_id % 2 AS VARCHAR), user_id, event_id FROM n WHERE name = 'client.pool')
    SELECT kind, metric, replace(tags, 'job_class=,', '') AS tags, round(CASE kind WHEN 'gauge' THEN arg_max(value, event_id) ELSE sum(value) END, 4) AS value, count(*) AS n FROM p GROUP BY kind, metric, tags""")
def metric_catalogue(s: Source) -> DataFrame:
    """All event names as metrics with their labels."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return stats.event_points(_notices(s)).select("kind", "metric", tags.alias("tags"), F.round("value", 4).alias("value"), "n")


@query(f"""WITH n AS (SELECT *, {_NAMES_SQL} AS name FROM events), q AS (SELECT * FROM n WHERE name IN ('client.send_message', 'client.send_batch'))
    SELECT 'messages_sent' AS name, 0 AS place, '# TYPE messages_sent counter' AS line UNION ALL SELECT 'messages_sent', 1, 'messages_sent{{queue="q' || CAST(user_id % 3 AS VARCHAR) || '"}} ' || CAST(sum(CASE name WHEN 'client.send_batch' THEN event_id % 4 ELSE 1 END) AS VARCHAR) FROM q GROUP BY user_id % 3
    UNION ALL SELECT 'event_count', 0, '# TYPE event_count counter' UNION ALL SELECT 'event_count', 1, 'event_count{{handler="H' || chr(92) || '"1",status="' || replace(name, 'event_', '') || '"}} ' || CAST(count(*) AS VARCHAR) FROM n WHERE name IN ('event_processed', 'event_failed') GROUP BY name""")
def prometheus_registry(s: Source) -> DataFrame:
    """The registry's text of two counters; labels by name and escaped."""
    return sinks.prometheus_registry(stats.event_points(_notices(s)).where("metric IN ('messages_sent', 'event_count')"))


@query(f"""WITH t AS (SELECT queue_name, live, dead, round(dead / (dead + live), 4) AS bloat FROM ({_TABLES}) x)
    SELECT 'table_live' AS name, 0 AS place, '# HELP table_live Live rows' AS line UNION ALL SELECT 'table_live', 1, '# TYPE table_live gauge' UNION ALL SELECT 'table_live', 2, 'table_live{{queue_name="' || queue_name || '"}} ' || live FROM t
    UNION ALL SELECT 'table_bloat', 0, '# HELP table_bloat Share of dead rows' UNION ALL SELECT 'table_bloat', 1, '# TYPE table_bloat gauge' UNION ALL SELECT 'table_bloat', 2, 'table_bloat{{queue_name="' || queue_name || '"}} ' || CASE WHEN bloat = floor(bloat) THEN CAST(CAST(bloat AS BIGINT) AS VARCHAR) ELSE CAST(bloat AS VARCHAR) END FROM t""")
def prometheus_families(s: Source) -> DataFrame:
    """Several families at once; one without any value is left out."""
    rows = _tables(s).withColumns({"bloat": F.round(F.col("dead") / (F.col("dead") + F.col("live")), 4), "none": F.lit(None).cast("double")})
    return sinks.prometheus_families(rows, {"table_live": ("live", "Live rows"), "table_bloat": ("bloat", "Share of dead rows"), "table_none": ("none", "Nothing")}, ["queue_name"])


@query("""SELECT 'status_counts' AS name, '[' || string_agg(json, ',' ORDER BY json) || ']' AS json FROM (SELECT '{"status":"' || status || '","n":' || count(*) || '}' AS json FROM job_stats GROUP BY status) a
    UNION ALL SELECT 'live_streams', '[' || string_agg(json, ',' ORDER BY json) || ']' FROM (SELECT '{"stream_name":"' || stream_name || '","broadcasts":' || broadcasts || ',"active":' || active || '}' AS json FROM (""" + _COUNTERS + """) c) b""")
def insights_bundle(s: Source) -> DataFrame:
    """Two of the overview's reports as JSON; test_rules.py looks at all of them."""
    bundle = stats.insights(s.job_stats, s.stream_stats, NOW, 10**6)
    return sinks.json_bundle({k: bundle[k] for k in ("status_counts", "live_streams")})


@query(f"""WITH m AS (SELECT q.*, coalesce(s.paused, false) AS paused FROM ({_METRICS}) q LEFT JOIN queue_states s ON 'mq_' || s.queue_name = q.queue_name),
    g AS (SELECT 'queue:' || queue_name AS tag, unnest(['queue_depth', 'queue_visible_depth', 'queue_paused', 'queue_oldest_message_age_seconds', 'queue_oldest_claimable_age_seconds', 'queue_latency']) AS gauge,
        unnest([CAST(length AS DOUBLE), visible, CAST(paused AS INT), oldest_age_s, oldest_claimable_s, coalesce(oldest_claimable_s, 0) * 1000]) AS value FROM m
    UNION ALL SELECT 'hostname:' || hostname, 'active_processes', count(*) FROM processes GROUP BY hostname
    UNION ALL SELECT '', unnest(['total_queues', 'total_depth', 'total_visible']), unnest([count(*), sum(length), sum(visible)]) FROM m
    UNION ALL SELECT '', unnest(['stream_broadcasts', 'stream_connects']), unnest([count(*) FILTER (WHERE event_type = 'broadcast'), count(*) FILTER (WHERE event_type = 'connect')]) FROM stream_stats)
    SELECT gauge, tag, CAST(value AS DOUBLE) AS value FROM g WHERE value IS NOT NULL""")
def all_gauges(s: Source) -> DataFrame:
    own = metrics.paused_flags(metrics.queue_metrics(s.queue_messages, NOW), s.queue_states)
    total = metrics.dashboard(own).select(F.col("queues").alias("total_queues"), "total_depth", "total_visible")
    streams = stats.stream_summary(s.stream_stats).select(F.col("broadcasts").alias("stream_broadcasts"), F.col("connects").alias("stream_connects"))
    return metrics.gauges(own, s.processes, total, streams)


_WORKERS = "SELECT id, id % 7 AS priority, 'q' || CAST(id % 5 AS VARCHAR) AS q1, 'q' || CAST(id % 3 AS VARCHAR) AS q2, last_heartbeat_at FROM processes"


@query(f"""SELECT a.id, greatest(0, coalesce(max(b.priority), 0)) AS max_priority FROM ({_WORKERS}) a LEFT JOIN ({_WORKERS}) b ON b.id <> a.id AND b.last_heartbeat_at > {_T} - INTERVAL 87000 SECOND AND (b.q1 IN (a.q1, a.q2) OR b.q2 IN (a.q1, a.q2)) GROUP BY a.id""")
def peer_priority(s: Source) -> DataFrame:
    """By worker the highest priority of other live workers that share a queue with it."""
    queue = lambda n: F.concat(F.lit("q"), (F.col("id") % n).cast("string"))
    workers = s.processes.select("id", (F.col("id") % 7).alias("priority"), F.array_distinct(F.array(queue(5), queue(3))).alias("queues"), "last_heartbeat_at")
    return metrics.peer_priority(workers, NOW, 87_000)
