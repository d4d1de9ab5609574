"""Queries over state: idempotency, batches, locks, breakers, retention, joins between logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, times, values
from tidemark.operators import claims, schedules, state
from tidemark.plans.registry import query
from tidemark.sources import queues
from tidemark.sources.views import NOW, Source
from tidemark.streaming import fanout

_T = f"TIMESTAMP '{NOW}'"
_LOCKED = """SELECT o_orderkey AS msg_id, 'mq_orders' AS queue_name, CASE WHEN o_orderkey % 3 = 0 THEN '{"uniqueness_key":"lock' || CAST(o_orderkey % 900 AS VARCHAR) || '"}' ELSE '{}' END AS message FROM orders"""


@query("SELECT event_id, handler_class FROM processed_events WHERE completed_at IS NULL")
def idempotent_claim(s: Source) -> DataFrame:
    return state.to_run(s.processed_events.select("event_id", "handler_class"), s.processed_events)


_HOPS = """WITH RECURSIVE first AS (SELECT {key}, min(ts) AS ts FROM events GROUP BY ALL),
    hops AS (SELECT * FROM first UNION ALL SELECT h.{key}, (SELECT min(e.ts) FROM events e WHERE e.{key} = h.{key} AND {then}) FROM hops h WHERE h.ts IS NOT NULL)"""


@query(_HOPS.format(key="user_id", then="e.ts > h.ts + INTERVAL 3600 SECOND") + " SELECT user_id, ts FROM hops WHERE ts IS NOT NULL")
def dedup_cache(s: Source) -> DataFrame:
    """Times at which a user's events pass the cache of the process they come to: those more than the TTL after the last that passed."""
    rows = s.events.select((F.col("user_id") % 16).alias("process"), F.col("user_id"), "ts").distinct()
    return state.dedup_cache(rows, "process", "user_id", "ts", 3600).select("user_id", "ts")


@query("""SELECT event_type, user_id, ts, event_id FROM (SELECT *, lag(user_id) OVER w AS before, lag(ts) OVER w AS at FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, user_id, event_id)) e
    WHERE before IS NULL OR before <> user_id""")
def dedup_cache_of_one(s: Source) -> DataFrame:
    """A cache of one entry a process: an event passes if its key is not the one that passed last."""
    rows = s.events.select("event_type", "user_id", "ts", "event_id")
    return state.dedup_cache(rows, "event_type", "user_id", "ts", 10**8, max_size=1)


_BATCH = """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'discarded') AS discarded FROM batch_jobs GROUP BY batch_id"""


@query(f"SELECT *, (completed + discarded) * 100 // total AS percent, completed + discarded = total AS finished FROM ({_BATCH}) b")
def batch_progress(s: Source) -> DataFrame:
    return state.batch_progress(s.batch_jobs)


@query("""SELECT lock_key, msg_id, CASE WHEN lock_key NOT IN (SELECT lock_key FROM locks WHERE user_id = 1) AND msg_id = min(msg_id) OVER (PARTITION BY lock_key) THEN 'enqueued' ELSE 'discarded' END AS outcome FROM locks""")
def uniqueness_acquire(s: Source) -> DataFrame:
    held = s.locks.where("user_id = 1").select("lock_key")
    return state.uniqueness(s.locks.select("lock_key", "msg_id"), held, "msg_id", on_conflict="discard")


@query("SELECT outcome, count(*) AS n FROM (SELECT 'enqueued' AS outcome FROM locks) o GROUP BY 1")
def uniqueness_while_executing(s: Source) -> DataFrame:
    return state.uniqueness(s.locks.select("lock_key", "msg_id"), s.locks.select("lock_key"), "msg_id", until="executing").groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT lock_key, min(msg_id) AS msg_id FROM locks WHERE lock_key NOT IN (SELECT lock_key FROM locks WHERE user_id = 1) GROUP BY lock_key")
def lock_winners(s: Source) -> DataFrame:
    return state.acquire(s.locks.select("lock_key", "msg_id"), s.locks.where("user_id = 1").select("lock_key"), "msg_id")


_HELD = "SELECT lock_key AS key, count(*) AS value, 3 AS max_value, max(created_at) AS expires_at FROM locks WHERE user_id < 3 GROUP BY 1"


def _held(s: Source) -> DataFrame:
    rows = s.locks.where("user_id < 3").groupBy(F.col("lock_key").alias("key"))
    return rows.agg(F.count("*").alias("value"), F.lit(3).cast("long").alias("max_value"), F.max("created_at").alias("expires_at"))


_GRANTS = f"""SELECT l.lock_key AS key, l.msg_id, l.created_at, row_number() OVER (PARTITION BY l.lock_key ORDER BY l.msg_id) + coalesce(h.value, 0) <= 3 AS granted
    FROM locks l LEFT JOIN ({_HELD}) h ON h.key = l.lock_key WHERE l.user_id >= 3"""


def _grants(s: Source) -> DataFrame:
    return state.semaphore_grants(s.locks.where("user_id >= 3").select(F.col("lock_key").alias("key"), "msg_id", "created_at"), 3, "msg_id", _held(s))


@query(f"SELECT key, msg_id, granted FROM ({_GRANTS}) g")
def semaphore_acquire(s: Source) -> DataFrame:
    return _grants(s).select("key", "msg_id", "granted")


@query(f"""SELECT coalesce(h.key, n.key) AS key, coalesce(h.value, 0) + coalesce(n.n, 0) AS value, 3 AS max_value, greatest(coalesce(h.expires_at, n.until), coalesce(n.until, h.expires_at)) AS expires_at
    FROM ({_HELD}) h FULL JOIN (SELECT key, count(*) AS n, max(created_at) + INTERVAL 60 SECOND AS until FROM ({_GRANTS}) g WHERE granted GROUP BY key) n ON n.key = h.key""")
def semaphore_values(s: Source) -> DataFrame:
    """Semaphores after the requests: slots taken and the latest expiry."""
    granted = _grants(s).where("granted").select("key", (F.col("created_at") + F.expr("INTERVAL 60 SECOND")).alias("expires_at"))
    return state.semaphores_after(_held(s), granted, 3)


@query(f"""SELECT h.key, b.id FROM ({_HELD}) h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concurrency_key ORDER BY priority, created_at, id) AS r FROM
    (SELECT id, 'lock' || CAST(id % 500 AS VARCHAR) AS concurrency_key, priority, created_at, expires_at FROM blocked) k WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00') x WHERE r = 1) b ON b.concurrency_key = h.key
    WHERE h.expires_at < TIMESTAMP '2024-01-15 00:00:00'""")
def semaphore_expiry(s: Source) -> DataFrame:
    """Keys whose semaphore has expired, with the blocked execution that may go on now."""
    blocked = s.blocked.withColumn("concurrency_key", F.concat(F.lit("lock"), (F.col("id") % 500).cast("string")))
    gone, _, free = state.semaphores_expired(_held(s), blocked, "2024-01-15 00:00:00")
    return gone.join(free.select(F.col("concurrency_key").alias("key"), "id"), "key", "left")


@query("SELECT lock_key AS key, greatest(3 - count(*), 0) AS value FROM locks GROUP BY 1")
def semaphore_release(s: Source) -> DataFrame:
    keys = s.locks.select(F.col("lock_key").alias("key"))
    return state.semaphore_release(keys.distinct().withColumn("value", F.lit(3).cast("long")), keys)


@query(f"SELECT concurrency_key, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY concurrency_key ORDER BY priority, created_at, id) AS r FROM blocked WHERE expires_at > {_T}) b WHERE r = 1")
def blocked_release(s: Source) -> DataFrame:
    return state.next_blocked(s.blocked, NOW).select("concurrency_key", "id", "priority")


_STREAK = """SELECT *, CASE WHEN status <> 'success' THEN count(*) FILTER (WHERE status <> 'success') OVER (PARTITION BY queue_name, island ORDER BY created_at, id) ELSE 0 END AS streak FROM
    (SELECT *, count(*) FILTER (WHERE status = 'success') OVER (PARTITION BY queue_name ORDER BY created_at, id) AS island FROM job_stats) i"""


@query(f"SELECT queue_name, id, streak FROM ({_STREAK}) s WHERE streak > 0")
def failure_streaks(s: Source) -> DataFrame:
    return state.streaks(s.job_stats, "queue_name", ["created_at", "id"], F.col("status") != "success").where("streak > 0").select("queue_name", "id", "streak")


@query(f"""SELECT queue_name, id, trip, least(30.0 * pow(2.0, trip - 1), 600.0) AS pause_s FROM
    (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY created_at, id) AS trip FROM ({_STREAK}) s WHERE streak > 0 AND streak % 2 = 0) t""")
def circuit_breaker(s: Source) -> DataFrame:
    return state.breaker_trips(s.job_stats, "queue_name", ["created_at", "id"], F.col("status") != "success", after=2).select("queue_name", "id", "trip", "pause_s")


@query(f"SELECT queue_name, id, CASE WHEN streak > 0 THEN least(1.0 * pow(2.0, streak - 1), 60.0) ELSE 0.0 END AS delay_s FROM ({_STREAK}) s")
def restart_backoff(s: Source) -> DataFrame:
    return state.restart_delays(s.job_stats, "queue_name", ["created_at", "id"], F.col("status") != "success").select("queue_name", "id", "delay_s")


@query(f"SELECT queue_name, id, CASE WHEN streak >= 2 THEN least(30.0 * pow(2.0, streak - 2), 600.0) ELSE 0.0 END AS delay_s FROM ({_STREAK}) s")
def maintenance_backoff(s: Source) -> DataFrame:
    rows = state.streaks(s.job_stats, "queue_name", ["created_at", "id"], F.col("status") != "success")
    return rows.select("queue_name", "id", state.maintenance_backoff(F.col("streak")).alias("delay_s"))


@query("SELECT read_ct, CASE WHEN read_ct - 1 >= 1 THEN least(5.0 * pow(2.0, read_ct - 2), 300.0) ELSE 0.0 END AS delay_s, count(*) AS n FROM queue_messages GROUP BY 1")
def retry_backoff(s: Source) -> DataFrame:
    return s.queue_messages.groupBy("read_ct").agg(F.count("*").alias("n")).withColumn("delay_s", values.retry_delay(F.col("read_ct")))


@query("SELECT CASE WHEN read_ct > 5 THEN 'dead_lettered' WHEN msg_id % 3 > 0 THEN 'success' ELSE 'failed' END AS outcome, count(*) AS n FROM queue_messages GROUP BY 1")
def job_outcome(s: Source) -> DataFrame:
    return s.queue_messages.groupBy(state.job_outcome(F.col("read_ct"), F.col("msg_id") % 3 > 0).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"SELECT queue_name, count(*) AS n FROM queue_messages WHERE enqueued_at >= {_T} - INTERVAL 604800 SECOND GROUP BY 1")
def retention_archive(s: Source) -> DataFrame:
    return state.retained(s.queue_messages, "enqueued_at", NOW, 7 * 86_400).groupBy("queue_name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM outbox_entries WHERE published_at IS NULL OR published_at >= TIMESTAMP '1997-01-02 00:00:00' - INTERVAL 86400 SECOND")
def retention_outbox(s: Source) -> DataFrame:
    return state.retained(s.outbox_entries, "published_at", "1997-01-02 00:00:00", 86_400).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT stream_name, CASE WHEN stream_name = 'room:3' THEN 60 WHEN regexp_matches(stream_name, '^room:1') THEN 900 WHEN regexp_matches(stream_name, '5$') THEN 30 ELSE 300 END AS keep_s FROM stream_stats")
def stream_retention(s: Source) -> DataFrame:
    rules = s.spark.createDataFrame([(2, "regex", "5$", 30), (1, "regex", "^room:1", 900), (3, "exact", "room:3", 60)], "place int, kind string, name string, seconds int")
    return state.stream_retention(s.stream_stats, rules)


@query(f"SELECT stream_name FROM (SELECT stream_name, count(*) AS n, max(created_at) AS last_at FROM stream_stats GROUP BY 1) x WHERE n = 0 OR epoch({_T} - last_at) >= 87000")
def orphan_streams(s: Source) -> DataFrame:
    streams = s.stream_stats.groupBy("stream_name").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    return state.orphan_streams(streams, NOW, 87_000).select("stream_name")


@query(f"""SELECT l.lock_key, l.msg_id FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'mq_low' ELSE 'mq_gone' END AS queue_name FROM locks) l
    WHERE l.created_at < {_T} - INTERVAL 60 SECOND AND l.queue_name IN (SELECT queue_name FROM queue_messages)
    AND NOT EXISTS (SELECT 1 FROM queue_messages m WHERE m.queue_name = l.queue_name AND m.msg_id = l.msg_id)""")
def orphan_locks(s: Source) -> DataFrame:
    locks = s.locks.withColumn("queue_name", F.when(F.col("user_id") % 2 == 0, "mq_low").otherwise("mq_gone"))
    return state.orphan_locks(locks, s.queue_messages, NOW).select("lock_key", "msg_id")


@query("""SELECT l.msg_id, l.queue_name, CASE WHEN l.queue_name = 'mq_low' THEN m.msg_id IS NOT NULL END AS "exists" FROM (SELECT msg_id, CASE WHEN user_id % 2 = 0 THEN 'mq_low' ELSE 'mq_gone' END AS queue_name FROM locks) l
    LEFT JOIN queue_messages m ON m.queue_name = l.queue_name AND m.msg_id = l.msg_id""")
def message_exists(s: Source) -> DataFrame:
    ids = s.locks.select("msg_id", F.when(F.col("user_id") % 2 == 0, "mq_low").otherwise("mq_gone").alias("queue_name"))
    return state.message_exists(ids, s.queue_messages)


@query("""SELECT m.queue_name, m.msg_id FROM queue_messages m WHERE m.read_ct > 1 AND NOT EXISTS
    (SELECT 1 FROM (SELECT msg_id, CASE WHEN msg_id % 2 = 0 THEN 'mq_default' ELSE 'mq_low' END AS queue_name FROM failed_events) f WHERE f.queue_name = m.queue_name AND f.msg_id = m.msg_id)""")
def zombies(s: Source) -> DataFrame:
    """Messages read again though no failure of that queue and message is on record."""
    failures = s.failed_events.select("msg_id", F.when(F.col("msg_id") % 2 == 0, "mq_default").otherwise("mq_low").alias("queue_name"))
    return state.zombies(s.queue_messages, failures).select("queue_name", "msg_id")


@query("SELECT queue_name, error_class, max(failed_at) AS failed_at, count(*) AS n FROM failed_events GROUP BY 1, 2")
def failures_by_class(s: Source) -> DataFrame:
    last = state.latest_failures(s.failed_events)
    return last.groupBy("queue_name", "error_class").agg(F.max("failed_at").alias("failed_at"), F.count("*").alias("n"))


@query(f"SELECT lock_key, msg_id, CAST(round_even(epoch({_T} - created_at), 0) AS BIGINT) AS age_s FROM locks ORDER BY created_at DESC, msg_id LIMIT 100")
def recent_locks(s: Source) -> DataFrame:
    rows = s.locks.orderBy(F.desc("created_at"), "msg_id").limit(100)
    return rows.select("lock_key", "msg_id", times.age_seconds(NOW, F.col("created_at")).alias("age_s"))


@query("SELECT queue_name, msg_id, error_class FROM failed_events ORDER BY failed_at DESC, msg_id LIMIT 25 OFFSET 25")
def failed_page(s: Source) -> DataFrame:
    return s.failed_events.orderBy(F.desc("failed_at"), "msg_id").offset(25).limit(25).select("queue_name", "msg_id", "error_class")


@query("SELECT event_id, handler_class FROM processed_events ORDER BY processed_at DESC, CAST(event_id AS BIGINT) LIMIT 25 OFFSET 75")
def processed_page(s: Source) -> DataFrame:
    return s.processed_events.orderBy(F.desc("processed_at"), F.col("event_id").cast("long")).offset(75).limit(25).select("event_id", "handler_class")


@query("SELECT msg_id, count(DISTINCT queue_name) AS queues FROM (SELECT msg_id, queue_name FROM queue_messages UNION ALL SELECT msg_id, 'mq_other_dlq' FROM failed_events) u WHERE ends_with(queue_name, '_dlq') GROUP BY msg_id HAVING count(DISTINCT queue_name) > 1")
def ambiguous_ids(s: Source) -> DataFrame:
    """Ids that more than one dead-letter queue holds."""
    rows = s.queue_messages.select("msg_id", "queue_name").unionByName(s.failed_events.select("msg_id", F.lit("mq_other_dlq").alias("queue_name")))
    return rows.where(names.is_dead_letters(F.col("queue_name"))).groupBy("msg_id").agg(F.countDistinct("queue_name").alias("queues")).where("queues > 1")


@query("SELECT DISTINCT queue_name, 'a_' || queue_name || '_msg_id_idx' AS index_name FROM queue_messages WHERE queue_name IN ('mq_mailers', 'mq_low')")
def stream_fingerprints(s: Source) -> DataFrame:
    """Queues that the index catalog shows to be streams."""
    indexes = s.spark.createDataFrame([("a_mq_mailers_msg_id_idx",), ("a_mq_low_msg_id_idx",), ("a_mq_gone_msg_id_idx",), ("q_mq_billing_vt_idx",)], "index_name string")
    return state.fingerprints(s.queue_messages, indexes)


@query("SELECT queue_name FROM (SELECT DISTINCT queue_name FROM queue_messages WHERE queue_name IN ('mq_mailers', 'mq_low')) q WHERE queue_name NOT IN (SELECT queue_name FROM stream_queues)")
def unregistered_streams(s: Source) -> DataFrame:
    """Queues that have a stream's index but are not registered as streams."""
    indexes = s.spark.createDataFrame([("a_mq_mailers_msg_id_idx",), ("a_mq_low_msg_id_idx",), ("a_mq_gone_msg_id_idx",), ("q_mq_billing_vt_idx",)], "index_name string")
    return state.unregistered(s.queue_messages.select("queue_name").distinct(), indexes, s.stream_queues)


@query("SELECT queue_name, queue_name IN (SELECT queue_name FROM stream_queues) OR queue_name = 'mq_low' AS drained, true AS by_all FROM (SELECT DISTINCT queue_name FROM queue_messages) q")
def drain_partition(s: Source) -> DataFrame:
    """Which queues are claimed from: by some processes, and where one claims from all."""
    own = s.queue_messages.select("queue_name").distinct()
    some = s.stream_queues.select("queue_name").unionByName(s.spark.createDataFrame([("mq_low",)], "queue_name string"))
    return state.drained_split(state.drained_split(own, None).withColumnRenamed("drained", "by_all"), some)


@query("SELECT queue_name FROM (VALUES ('mq_low'), ('mq_nowhere')) c(queue_name) WHERE queue_name NOT IN (SELECT queue_name FROM queue_messages)")
def missing_queues(s: Source) -> DataFrame:
    configured = s.spark.createDataFrame([("mq_low",), ("mq_nowhere",)], "queue_name string")
    return configured.join(s.queue_messages.select("queue_name").distinct(), "queue_name", "left_anti")


@query("SELECT m.msg_id, m.queue_name FROM queue_messages m WHERE m.queue_name IN ('mq_billing', 'mq_mailers') ORDER BY msg_id DESC LIMIT 50")
def pending_events(s: Source) -> DataFrame:
    handlers = s.spark.createDataFrame([("mq_billing",), ("mq_mailers",), ("mq_gone",)], "queue_name string")
    return queues.page(s.queue_messages.join(F.broadcast(handlers), "queue_name", "left_semi"), 50).select("msg_id", "queue_name")


@query("""SELECT c.client, m.stream_name, m.msg_id FROM (SELECT *, CASE role WHEN 'system' THEN 'typo' WHEN 'assistant' THEN NULL ELSE CASE WHEN msg_id % 4 = 0 THEN 'admins' ELSE 'members' END END AS label FROM stream_messages) m,
    (VALUES ('root', true, 1), ('guest', false, NULL)) c(client, admin, level) WHERE m.label IS NULL OR (m.label = 'admins' AND c.admin) OR (m.label = 'members' AND coalesce(c.level > 0, false))""")
def audience_filter(s: Source) -> DataFrame:
    """Who sees which broadcast: no label, everybody; an unknown label or a predicate without an answer, nobody."""
    clients = s.spark.createDataFrame([("root", True, 1), ("guest", False, None)], "client string, admin boolean, level int")
    label = F.when(F.col("role") == "system", "typo").when(F.col("role") != "assistant", F.when(F.col("msg_id") % 4 == 0, "admins").otherwise("members"))
    rows = s.stream_messages.withColumn("label", label).join(F.broadcast(clients))  # two rows
    return rows.where(fanout.visible_to(F.col("label"), {"admins": F.col("admin"), "members": F.col("level") > 0})).select("client", "stream_name", "msg_id")


@query("SELECT event_id, user_id FROM events WHERE user_id IS NULL OR user_id <> 7")
def exclude_filter(s: Source) -> DataFrame:
    return s.events.where(F.col("user_id").isNull() | (F.col("user_id") != 7)).select("event_id", "user_id")


_CRONS = {"hourly": "5 * * * *", "weekday": "*/20 9-11 * * mon-tue", "monthly": "0 6 1,15 jan *"}


@query("""SELECT n_name AS key, run_at FROM (SELECT n_name, n_nationkey % 3 AS kind, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-16 23:59:00', INTERVAL 1 MINUTE)) AS run_at FROM nation) t
    WHERE (kind = 0 AND minute(run_at) = 5) OR (kind = 1 AND minute(run_at) % 20 = 0 AND hour(run_at) BETWEEN 9 AND 11 AND dayofweek(run_at) IN (1, 2))
    OR (kind = 2 AND minute(run_at) = 0 AND hour(run_at) = 6 AND day(run_at) IN (1, 15) AND month(run_at) = 1)""")
def cron_due(s: Source) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _CRONS)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return schedules.due_runs(s.nation.select(F.col("n_name").alias("key"), kind.alias("kind")), _CRONS, "2024-01-01 00:00:00", "2024-01-16 23:59:00", "kind")


@query("""SELECT event_id, date_trunc('hour', ts) + INTERVAL 5 MINUTE + CASE WHEN minute(ts) >= 5 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS next_at,
    date_trunc('hour', ts) + INTERVAL 5 MINUTE - CASE WHEN ts > date_trunc('hour', ts) + INTERVAL 5 MINUTE THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS previous_at,
    CASE WHEN epoch(ts - date_trunc('hour', ts)) BETWEEN 300 AND 900 THEN date_trunc('hour', ts) + INTERVAL 5 MINUTE END AS run_at FROM events""")
def cron_neighbours(s: Source) -> DataFrame:
    """Due times around each event, and the one that a look at the clock then would fire."""
    ts, cron = F.col("ts"), _CRONS["hourly"]
    return s.events.select("event_id", schedules.next_due(ts, cron, 2).alias("next_at"), schedules.previous_due(ts, cron, 2).alias("previous_at"), schedules.run_time(ts, cron, 600).alias("run_at"))


@query("SELECT t.key, e.last_run_at FROM (VALUES ('u1'), ('u2'), ('none')) t(key) LEFT JOIN (SELECT 'u' || CAST(user_id AS VARCHAR) AS key, max(ts) AS last_run_at FROM events GROUP BY 1) e ON e.key = t.key")
def last_runs(s: Source) -> DataFrame:
    tasks = s.spark.createDataFrame([("u1",), ("u2",), ("none",)], "key string")
    return schedules.last_runs(tasks, s.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task_key"), F.col("ts").alias("run_at")))


@query("SELECT DISTINCT user_id, date_trunc('hour', ts) AS run_at FROM events")
def recurring_dedup(s: Source) -> DataFrame:
    return s.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run_at")).dropDuplicates(["user_id", "run_at"])


@query("SELECT CAST(r_regionkey AS VARCHAR) || n AS key, n = 'a' AS static, n || r_name AS command FROM region, (VALUES ('a'), ('c')) v(n) WHERE n = 'a' OR r_regionkey % 2 = 0")
def recurring_sync(s: Source) -> DataFrame:
    """Recurring tasks after a sync: the configured ones ('a') replace their old rows, other static ones ('b') go, the rest ('c') stay."""
    task = lambda n, static, command: s.region.select(F.concat(F.col("r_regionkey").cast("string"), F.lit(n)).alias("key"), F.lit(static).alias("static"), command.alias("command"))
    name = F.col("r_name")
    old = task("a", True, F.lit("old")).unionByName(task("b", True, name)).unionByName(task("c", False, F.concat(F.lit("c"), name)).where("key RLIKE '^[024]'"))
    return state.sync(old, task("a", True, F.concat(F.lit("a"), name)), ["key"])


@query("SELECT regexp_replace(queue_name, '^mq_', '') AS queue_name, count(*) % 2 = 0 AS paused FROM queue_messages GROUP BY 1")
def pause_resume(s: Source) -> DataFrame:
    """Queue states after every queue was paused or resumed by the parity of its length; none was there twice."""
    new = s.queue_messages.groupBy(names.logical(F.col("queue_name")).alias("queue_name")).agg((F.count("*") % 2 == 0).alias("paused"))
    return state.merge(s.queue_states, new, ["queue_name"])


@query("SELECT pattern, queue_name FROM topic_bindings UNION ALL SELECT 'new.#', 'q_all'")
def bind_topic(s: Source) -> DataFrame:
    """Bindings after new ones: known ones stay as they are, bad patterns and queues that don't exist are refused."""
    new = s.spark.createDataFrame([("new.#", "q_all"), ("#", "q_all"), ("a.**", "q_all"), ("x.*", "q_nowhere")], "pattern string, queue_name string")
    queues_ = s.topic_bindings.select("queue_name").distinct()
    return state.bound(s.topic_bindings.select("pattern", "queue_name"), state.bindable(new, queues_)[0])


@query("SELECT * FROM (VALUES ('a.**', 'pattern'), ('x.*', 'queue')) v(pattern, refused)")
def bind_topic_refused(s: Source) -> DataFrame:
    new = s.spark.createDataFrame([("new.#", "q_all"), ("a.**", "q_all"), ("x.*", "q_nowhere")], "pattern string, queue_name string")
    return state.bindable(new, s.topic_bindings.select("queue_name").distinct())[1].select("pattern", "refused")


@query("SELECT pattern, queue_name, queue_name = 'q_all' AS existed FROM (SELECT DISTINCT pattern, 'q_all' AS queue_name FROM topic_bindings WHERE queue_name = 'q_all' UNION ALL SELECT '#', 'q_click') v")
def unbind_topic(s: Source) -> DataFrame:
    """Which of the bindings to remove were there."""
    gone = s.topic_bindings.where("queue_name = 'q_all'").select("pattern", "queue_name").unionByName(s.spark.createDataFrame([("#", "q_click")], "pattern string, queue_name string"))
    return state.unbound(s.topic_bindings, gone)[0]


@query("SELECT pattern, queue_name, bound_at FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(length(pattern)) AS bound_at FROM topic_bindings) b ORDER BY bound_at DESC, pattern, queue_name LIMIT 4")
def list_bindings(s: Source) -> DataFrame:
    """Bindings by bound_at, newest first, then pattern; a page of them."""
    rows = s.topic_bindings.withColumn("bound_at", times.moment("2024-01-01 00:00:00") + F.make_dt_interval(hours=F.length("pattern")))
    return state.bindings(rows).limit(4).select("pattern", "queue_name", "bound_at")


@query("SELECT a.id AS id, max(b.priority) AS max_priority FROM (SELECT user_id AS id, user_id % 5 AS q FROM events GROUP BY 1, 2) a JOIN (SELECT user_id AS id, user_id % 5 AS q, user_id % 11 AS priority FROM events GROUP BY 1, 2, 3) b ON a.q = b.q GROUP BY 1")
def consumer_priority(s: Source) -> DataFrame:
    """By worker the highest priority among workers that share a queue: by way of each queue's own maximum."""
    workers = s.events.select("user_id").distinct().select(F.col("user_id").alias("id"), (F.col("user_id") % 11).alias("priority"), F.array(F.col("user_id") % 5).alias("queues"))
    each = workers.select("id", "priority", F.explode("queues").alias("queue"))
    top = each.groupBy("queue").agg(F.max("priority").alias("top"))
    return each.join(top, "queue").groupBy("id").agg(F.max("top").alias("max_priority"))


@query("SELECT queue_name, count(*) FILTER (WHERE special) AS special, count(*) FILTER (WHERE NOT special AND vt <= enqueued_at + INTERVAL 1 MINUTE) AS immediate, count(*) FILTER (WHERE NOT special AND vt > enqueued_at + INTERVAL 1 MINUTE) AS scheduled FROM (SELECT *, group_key IS NULL AS special FROM queue_messages) m GROUP BY 1")
def bulk_enqueue(s: Source) -> DataFrame:
    return state.enqueue_kinds(s.queue_messages, F.col("group_key").isNull(), F.col("enqueued_at") + F.expr("INTERVAL 1 MINUTE"))


@query(f"SELECT DISTINCT lock_key FROM locks WHERE lock_key NOT IN (SELECT json_extract_string(message, '$.uniqueness_key') FROM ({_LOCKED}) m WHERE message <> '{{}}' AND msg_id % 2 = 0)")
def bulk_release(s: Source) -> DataFrame:
    """Locks that stay when every second message is discarded."""
    return state.locks_after(s.locks, _locked(s).where("msg_id % 2 = 0")).select("lock_key").distinct()


@query("SELECT queue_name, count(*) AS n FROM queue_messages WHERE NOT (queue_name = 'mq_default_dlq') AND msg_id NOT IN (SELECT msg_id FROM locks) GROUP BY 1")
def bulk_discard(s: Source) -> DataFrame:
    rest = s.queue_messages.where(~names.is_dead_letters(F.col("queue_name"))).join(s.locks.select("msg_id"), "msg_id", "left_anti")
    return rest.groupBy("queue_name").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, handler_class, {_T} AS processed_at FROM processed_events WHERE completed_at IS NULL")
def mark_handled(s: Source) -> DataFrame:
    """Every pending event marked as handled; its message is archived."""
    pending = s.processed_events.where("completed_at IS NULL").select("event_id", "handler_class")
    return state.handled(pending, NOW)


@query("SELECT routing_key AS target, count(*) AS n FROM (SELECT e.event_id, m.routing_key FROM processed_events e JOIN queue_messages m ON CAST(m.msg_id AS VARCHAR) = e.event_id WHERE e.completed_at IS NOT NULL) r GROUP BY 1")
def replay_events(s: Source) -> DataFrame:
    """Handled events as they would be published again: by routing key, or by handler where there is none."""
    rows = s.processed_events.where("completed_at IS NOT NULL").join(s.queue_messages.select(F.col("msg_id").cast("string").alias("event_id"), "routing_key"), "event_id")
    return state.replayed(rows).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN read_ct > 5 THEN 'dead_lettered' WHEN msg_id % 7 = 0 THEN 'skipped' WHEN msg_id % 3 > 0 THEN 'success' ELSE 'failed' END AS outcome, CASE WHEN read_ct > 5 THEN 'move' WHEN msg_id % 7 <> 0 AND msg_id % 3 > 0 THEN 'archive' ELSE 'leave' END AS effect, count(*) AS n FROM queue_messages GROUP BY 1, 2")
def job_effects(s: Source) -> DataFrame:
    outcome = state.job_outcome(F.col("read_ct"), F.col("msg_id") % 3 > 0, locked=F.col("msg_id") % 7 == 0)
    return s.queue_messages.groupBy(outcome.alias("outcome"), state.job_effects(outcome).alias("effect")).agg(F.count("*").alias("n"))


@query("SELECT msg_id, read_ct > 5 AS dead FROM queue_messages")
def dead_letter_decision(s: Source) -> DataFrame:
    return s.queue_messages.select("msg_id", (state.job_outcome(F.col("read_ct"), F.lit(True)) == "dead_lettered").alias("dead"))


def _locked(s: Source) -> DataFrame:
    key = F.col("o_orderkey")
    body = F.when(key % 3 == 0, F.concat(F.lit('{"uniqueness_key":"lock'), (key % 900).cast("string"), F.lit('"}'))).otherwise("{}")
    return s.orders.select(key.alias("msg_id"), F.lit("mq_orders").alias("queue_name"), body.alias("message"))


@query(f"""SELECT lock_key, queue_name, CASE WHEN queue_name = 'mq_orders' THEN lock_key IN (SELECT json_extract_string(message, '$.uniqueness_key') FROM ({_LOCKED}) m WHERE message <> '{{}}') END AS "exists"
    FROM (SELECT DISTINCT lock_key, CASE WHEN user_id % 2 = 0 THEN 'mq_orders' ELSE 'mq_gone' END AS queue_name FROM locks) l""")
def message_exists_by_key(s: Source) -> DataFrame:
    keys = s.locks.select("lock_key", F.when(F.col("user_id") % 2 == 0, "mq_orders").otherwise("mq_gone").alias("queue_name")).distinct()
    return state.key_exists(keys, _locked(s))


@query(f"""SELECT lock_key, msg_id FROM (SELECT lock_key, -msg_id AS msg_id, created_at FROM locks) l WHERE created_at < {_T} - INTERVAL 60 SECOND
    AND lock_key NOT IN (SELECT json_extract_string(message, '$.uniqueness_key') FROM ({_LOCKED}) m WHERE message <> '{{}}')""")
def orphan_locks_by_key(s: Source) -> DataFrame:
    """Locks taken before their message had an id: gone if no body bears their key."""
    locks = s.locks.select("lock_key", (-F.col("msg_id")).alias("msg_id"), "created_at", F.lit("mq_orders").alias("queue_name"))
    return state.orphan_locks(locks, _locked(s), NOW).select("lock_key", "msg_id")


@query(f"""SELECT queue_name, max_at + to_seconds(pause_s) > TIMESTAMP '2024-01-30 23:00:00' AS paused FROM (SELECT queue_name, max(created_at) AS max_at, arg_max(least(30.0 * pow(2.0, trip - 1), 600.0), created_at) AS pause_s FROM
    (SELECT queue_name, created_at, row_number() OVER (PARTITION BY queue_name ORDER BY created_at, id) AS trip FROM ({_STREAK}) s WHERE streak > 0 AND streak % 2 = 0) t GROUP BY 1) u""")
def breaker_resumes(s: Source) -> DataFrame:
    """Which queues a breaker still holds; pauses end by themselves."""
    trips = state.breaker_trips(s.job_stats, "queue_name", ["created_at", "id"], F.col("status") != "success", after=2)
    return state.paused_at(trips, "queue_name", "created_at", "2024-01-30 23:00:00").select("queue_name", "paused")


@query("SELECT msg_id, CASE WHEN read_ct >= 2 THEN least(least(5.0 * pow(2.0, read_ct - 2), 300.0) * (1 + 0.15 * (2 * (msg_id % 100 / 100.0) - 1)), 300.0) ELSE 0.0 END AS delay_s FROM queue_messages")
def retry_jitter(s: Source) -> DataFrame:
    delay = values.retry_delay(F.col("read_ct"), jitter=0.15, chance=F.col("msg_id") % 100 / 100.0)
    return s.queue_messages.select("msg_id", delay.alias("delay_s"))


@query("SELECT CASE WHEN left(body, 1) = '{' THEN body WHEN left(body, 1) = '[' THEN body WHEN body LIKE 'no%' THEN '{\"value\":\"' || body || '\"}' ELSE '{\"value\":' || body || '}' END AS wrapped, CASE WHEN body LIKE '{\"html%' THEN 'x' || k ELSE body END AS unwrapped FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '{\"html\":\"x' || o_orderkey || '\"}' WHEN 1 THEN '[' || o_orderkey || ']' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN 'no json ' || o_orderkey ELSE '{\"a\":1}' END AS body FROM orders) b")
def envelopes(s: Source) -> DataFrame:
    """Payloads as events wrap them and as streams unwrap them."""
    key = F.col("o_orderkey").cast("string")
    kinds = [F.concat(F.lit('{"html":"x'), key, F.lit('"}')), F.concat(F.lit("["), key, F.lit("]")), key, F.concat(F.lit("no json "), key), F.lit('{"a":1}')]
    rows = s.orders.select(F.element_at(F.array(*kinds), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("body"))
    return rows.select(values.wrapped(F.col("body")).alias("wrapped"), values.unwrapped(F.col("body")).alias("unwrapped"))


@query("SELECT batch_id FROM (SELECT batch_id, CASE WHEN count(*) = count(*) FILTER (WHERE outcome <> 'pending') THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(batch_id % 40 AS INTEGER)) END AS finished_at FROM batch_jobs GROUP BY 1) b WHERE finished_at IS NULL OR finished_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def retention_batches(s: Source) -> DataFrame:
    """Batches that stay: those not finished, and those that finished in the last week."""
    rows = state.batch_progress(s.batch_jobs).withColumn("finished_at", F.when(F.col("finished"), times.moment("2024-01-01 00:00:00") + F.make_dt_interval(days=(F.col("batch_id") % 40).cast("int"))))
    return state.retained(rows, "finished_at", NOW, 7 * 86_400).select("batch_id")


@query("SELECT user_id, date_trunc('hour', ts) AS run_at FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY GROUP BY ALL")
def retention_recurring(s: Source) -> DataFrame:
    runs = s.events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run_at")).dropDuplicates(["user_id", "run_at"])
    return state.retained(runs, "run_at", NOW, 3 * 86_400)


@query("SELECT queue_name, count(*) AS n, max(msg_id) AS last_id FROM (SELECT queue_name, msg_id FROM queue_messages UNION ALL SELECT f.queue_name, coalesce(l.last_id, 0) + row_number() OVER (PARTITION BY f.queue_name ORDER BY f.msg_id) FROM (SELECT DISTINCT msg_id, CASE WHEN msg_id % 2 = 0 THEN 'mq_default' ELSE 'mq_low' END AS queue_name FROM failed_events) f LEFT JOIN (SELECT queue_name, max(msg_id) AS last_id FROM queue_messages GROUP BY 1) l ON l.queue_name = f.queue_name) u GROUP BY 1")
def bulk_retry(s: Source) -> DataFrame:
    """All failed jobs sent again: new messages beyond each queue's last one."""
    failed = s.failed_events.select("msg_id", F.when(F.col("msg_id") % 2 == 0, "mq_default").otherwise("mq_low").alias("queue_name"), F.lit(0).alias("read_ct"), "failed_at").distinct()
    rows = failed.select("queue_name", "msg_id", "read_ct", F.col("failed_at").alias("enqueued_at"), F.col("failed_at").alias("vt"))
    again = claims.produced(rows, claims.high_water(s.queue_messages), NOW)
    return s.queue_messages.select("queue_name", "msg_id").unionByName(again.select("queue_name", "msg_id")).groupBy("queue_name").agg(F.count("*").alias("n"), F.max("msg_id").alias("last_id"))
