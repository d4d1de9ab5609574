"""Queries over catalogs, settings and per-event metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, times
from tidemark.operators import admin, schedules, state
from tidemark.plans.registry import query
from tidemark.sources import queues
from tidemark.sources.views import NOW, Source
from tidemark.streaming import fanout

_T = f"TIMESTAMP '{NOW}'"


def _names(s: Source, *queues: str) -> DataFrame:
    return s.spark.createDataFrame([(q,) for q in queues], "queue_name string")


@query("SELECT DISTINCT queue_name FROM queue_messages UNION SELECT 'mq_new'")
def create_queue(s: Source) -> DataFrame:
    return admin.created(s.queue_messages.select("queue_name").distinct(), _names(s, "mq_new", "mq_low", "mq_new"))


@query("SELECT 'mq_' || n_name AS queue_name, n_nationkey % 2 = 0 AS existed FROM nation")
def drop_queue(s: Source) -> DataFrame:
    """Whether each queue to drop was there; the catalog holds every second one."""
    own = s.nation.select(F.concat(F.lit("mq_"), "n_name").alias("queue_name"), "n_nationkey")
    return admin.dropped(own.where("n_nationkey % 2 = 0").select("queue_name"), own.select("queue_name"))[0]


@query("SELECT DISTINCT queue_name, queue_name = 'mq_low' AS unlogged FROM queue_messages UNION ALL SELECT 'mq_fast', true")
def create_unlogged_queue(s: Source) -> DataFrame:
    """The catalog tells which queues are not logged; a known queue keeps what it is."""
    old = s.queue_messages.select("queue_name").distinct().withColumn("unlogged", F.col("queue_name") == "mq_low")
    return admin.created(old, s.spark.createDataFrame([("mq_fast", True), ("mq_billing", True)], "queue_name string, unlogged boolean"))


@query("SELECT stream_name, stream_name = 'room:3' OR regexp_matches(stream_name, '^room:1') AS durable, count(*) AS n FROM stream_stats GROUP BY 1")
def durable_streams(s: Source) -> DataFrame:
    rules = s.spark.createDataFrame([("room:3", False), ("^room:1", True)], "rule string, is_regex boolean")
    streams = s.stream_stats.groupBy("stream_name").agg(F.count("*").alias("n"))
    return admin.pattern_flag(streams, rules, False).withColumnRenamed("flag", "durable")


@query("SELECT * FROM (SELECT 'q_' || queue_name AS table_name, count(*) FILTER (WHERE read_ct < 5) AS live, count(*) FILTER (WHERE read_ct >= 5) AS dead, round(count(*) FILTER (WHERE read_ct >= 5) / count(*), 4) AS bloat FROM queue_messages GROUP BY queue_name) t WHERE table_name NOT LIKE '%dlq'")
def health_join(s: Source) -> DataFrame:
    stats = s.queue_messages.groupBy(F.concat(F.lit("q_"), "queue_name").alias("table_name")).agg(F.count_if(F.col("read_ct") < 5).alias("live"), F.count_if(F.col("read_ct") >= 5).alias("dead"))
    queues = s.queue_messages.select("queue_name").distinct().where(~names.is_dead_letters(F.col("queue_name")))
    return admin.with_health(queues, stats)


@query("SELECT count(*) AS used, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS listeners, 200000 - count(*) AS free FROM events")
def connection_headroom(s: Source) -> DataFrame:
    rows = s.events.select(F.col("user_id").alias("pid"), F.when(F.col("event_type") == "click", "LISTEN x").otherwise("SELECT 1").alias("query"))
    return admin.headroom(rows, 200_000)


@query("""SELECT 'counter' AS kind, 'clicks_total' AS metric, CAST(user_id % 3 AS VARCHAR) AS tag, CAST(count(*) AS DOUBLE) AS value, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 3
    UNION ALL SELECT 'gauge', 'last_view', CAST(user_id % 3 AS VARCHAR), arg_max(value, event_id), count(*) FROM events WHERE event_type = 'view' GROUP BY 3
    UNION ALL SELECT 'histogram', 'spent', CAST(user_id % 3 AS VARCHAR), round(sum(value), 4), count(*) FROM events WHERE event_type = 'purchase' GROUP BY 3""")
def event_metrics(s: Source) -> DataFrame:
    rows = s.events.select(F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("string").alias("tag"), "value", F.col("event_id").alias("at"))
    kinds = {"click": ("clicks_total", "counter"), "view": ("last_view", "gauge"), "purchase": ("spent", "histogram")}
    return admin.event_metrics(rows, kinds).withColumn("value", F.round("value", 4))


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 4) AS share FROM events GROUP BY user_id")
def utilisation(s: Source) -> DataFrame:
    rows = s.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("busy"), F.count("*").alias("all"))
    return rows.select("user_id", admin.utilisation(F.col("busy"), F.col("all")).alias("share"))


@query("""SELECT user_id, CASE WHEN c = 0 AND e = 0 THEN '' WHEN e = 0 THEN printf('%.1f', c / 2.0) || ' done/s' WHEN c = 0 THEN printf('%.1f', e / 2.0) || ' failed/s'
    ELSE printf('%.1f', c / 2.0) || ' done/s · ' || printf('%.1f', e / 2.0) || ' failed/s' END AS label FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS c, count(*) FILTER (WHERE event_type = 'error' AND user_id % 3 > 0) AS e FROM events GROUP BY 1) u""")
def worker_rates(s: Source) -> DataFrame:
    kind = F.col("event_type")
    rows = s.events.groupBy("user_id").agg(F.count_if(kind == "signup").alias("c"), F.count_if((kind == "error") & (F.col("user_id") % 3 > 0)).alias("e"))
    return rows.select("user_id", admin.rates_text({"done": F.col("c") / 2, "failed": F.col("e") / 2}).alias("label"))


@query("SELECT lock_key AS key, msg_id, CASE WHEN row_number() OVER (PARTITION BY lock_key ORDER BY msg_id) <= 1 THEN 'enqueue' ELSE 'block' END AS outcome FROM locks")
def enqueue_conflict(s: Source) -> DataFrame:
    rows = state.semaphore_grants(s.locks.select(F.col("lock_key").alias("key"), "msg_id"), 1, "msg_id")
    return rows.select("key", "msg_id", state.conflict_outcome(F.col("granted"), "block").alias("outcome"))


@query("""SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-03 10:05:00' END AS due_at FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0""")
def cron_catch_up(s: Source) -> DataFrame:
    """Runs to make up for: hourly tasks whose last one is missing; daily ones are too long ago."""
    tasks = s.nation.select(F.col("n_name").alias("key"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "hourly").otherwise("daily").alias("kind"))
    due = schedules.due_runs(tasks, {"hourly": "5 * * * *", "daily": "0 3 * * *"}, "2024-01-03 00:00:00", "2024-01-03 10:30:00", "kind")
    ran = tasks.select("key", F.when(F.col("n_nationkey") % 3 == 0, times.moment("2024-01-03 10:05:00")).otherwise(times.moment("2024-01-03 09:05:00")).alias("run_at"))
    return admin.missed_run(due, ran, "2024-01-03 10:30:00", 3600)


@query("SELECT 'mq_' || n_name AS queue_name, CASE n_nationkey % 4 WHEN 0 THEN 100 * n_regionkey WHEN 1 THEN 250 ELSE 500 END AS interval_ms FROM nation WHERE n_nationkey % 4 <> 3")
def throttle_settings(s: Source) -> DataFrame:
    """Settings after queues were updated (0), enabled without an interval (1: the default), left alone (2) and disabled (3)."""
    kind = F.col("n_nationkey") % 4
    own = s.nation.select(F.concat(F.lit("mq_"), "n_name").alias("queue_name"), kind.alias("kind"), (F.col("n_regionkey") * 100).alias("wanted"))
    old = own.where("kind <> 1").select("queue_name", F.lit(500).alias("interval_ms"))
    new = own.where("kind < 2").select("queue_name", F.when(F.col("kind") == 0, F.col("wanted")).cast("int").alias("interval_ms"))
    return admin.throttles_after(old, new, own.where("kind = 3").select("queue_name"))


@query("SELECT user_id, user_id % 4 AS writer FROM (SELECT DISTINCT user_id FROM events) e")
def writer_partitions(s: Source) -> DataFrame:
    """The writer of each client, by the hash it brings (here its number)."""
    return s.events.select("user_id").distinct().withColumn("writer", fanout.writer_of(F.col("user_id"), 4))


@query("SELECT c.client, m.stream_name, -1 - m.msg_id AS msg_id FROM stream_messages m, (VALUES ('a'), ('b')) c(client) WHERE m.role <> 'system' OR c.client = 'a'")
def ephemeral_fanout(s: Source) -> DataFrame:
    """Messages without storage: negative ids, no cursor, only the audience filter."""
    streams = s.stream_messages.select("stream_name").distinct()
    clients = streams.withColumn("client", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return fanout.ephemeral(s.stream_messages.withColumnRenamed("msg_id", "seq"), clients, (F.col("role") != "system") | (F.col("client") == "a"))


@query(f"SELECT id FROM processes WHERE last_heartbeat_at >= {_T} - INTERVAL 86700 SECOND")
def retention_processes(s: Source) -> DataFrame:
    return state.retained(s.processes, "last_heartbeat_at", NOW, 86_700).select("id")


@query(f"SELECT id FROM job_stats WHERE created_at >= {_T} - INTERVAL 1296000 SECOND")
def retention_stats(s: Source) -> DataFrame:
    return state.retained(s.job_stats, "created_at", NOW, 15 * 86_400).select("id")


@query(f"SELECT event_id, handler_class FROM processed_events WHERE processed_at >= {_T} - INTERVAL 604800 SECOND")
def retention_processed(s: Source) -> DataFrame:
    return state.retained(s.processed_events, "processed_at", NOW, 7 * 86_400).select("event_id", "handler_class")


@query("SELECT msg_id, queue_name || '_p' || least(read_ct, 2) AS target FROM queue_messages")
def send_target(s: Source) -> DataFrame:
    """The sub-queue of three levels that each message's priority leads to."""
    return s.queue_messages.select("msg_id", names.with_priority(F.col("queue_name"), F.col("read_ct"), 3).alias("target"))


@query("SELECT strftime(enqueued_at + INTERVAL 1 DAY, '%Y-%m-%d') AS partition, queue_name, count(*) AS n FROM queue_messages GROUP BY 1, 2")
def archive_partitions(s: Source) -> DataFrame:
    """An archive by days of archived_at, as when it is turned into a partitioned table."""
    rows = s.queue_messages.withColumn("archived_at", F.col("enqueued_at") + F.expr("INTERVAL 1 DAY"))
    return queues.partition_key(rows, "1 day", "archived_at").groupBy("partition", "queue_name").agg(F.count("*").alias("n"))


@query(f"SELECT msg_id FROM queue_messages WHERE enqueued_at >= {_T} - INTERVAL 2880 MINUTE AND read_ct = 0 ORDER BY msg_id DESC LIMIT 100")
def clamped_page(s: Source) -> DataFrame:
    minutes, rows = times.clamp_minutes(2880, 60), times.clamp_page(5000, 100)
    recent = s.queue_messages.where(times.since(NOW, F.col("enqueued_at"), minutes)).where("read_ct = 0")
    return recent.orderBy(F.desc("msg_id")).limit(rows).select("msg_id")
