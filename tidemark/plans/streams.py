"""Queries over streams in their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import stats
from tidemark.plans.registry import query
from tidemark.sources.views import NOW, Source
from tidemark.streaming import fanout, live

_T = f"TIMESTAMP '{NOW}'"
_CLIENTS = "(SELECT stream_name, 'a' AS client, 1 AS scanned, 0 AS sent FROM stream_messages GROUP BY 1 UNION ALL SELECT stream_name, 'b', 0, 2 FROM stream_messages GROUP BY 1)"


def _clients(s: Source) -> DataFrame:
    one = s.stream_messages.select("stream_name").distinct()
    return one.select("stream_name", F.lit("a").alias("client"), F.lit(1).alias("scanned"), F.lit(0).alias("sent")).unionByName(
        one.select("stream_name", F.lit("b").alias("client"), F.lit(0).alias("scanned"), F.lit(2).alias("sent"))
    )


@query(f"SELECT stream_name, CAST(min(greatest(scanned, sent)) AS BIGINT) AS cursor FROM {_CLIENTS} c GROUP BY 1")
def min_cursors(s: Source) -> DataFrame:
    return fanout.min_cursors(_clients(s))


@query(f"SELECT c.client, m.stream_name, m.msg_id FROM stream_messages m JOIN {_CLIENTS} c ON c.stream_name = m.stream_name WHERE m.msg_id > greatest(c.scanned, c.sent) AND m.role <> 'system'")
def durable_fanout(s: Source) -> DataFrame:
    return fanout.deliveries(s.stream_messages, _clients(s), F.col("role") != "system")


@query("SELECT c.client, m.stream_name, m.msg_id FROM stream_messages m JOIN (SELECT DISTINCT stream_name, 'a' AS client, 0 AS sent FROM stream_messages UNION ALL SELECT DISTINCT stream_name, 'b', 2 FROM stream_messages) c ON c.stream_name = m.stream_name WHERE m.msg_id > c.sent")
def connect_replay(s: Source) -> DataFrame:
    """What each client gets that connects: all of the replay, then what came in meanwhile, nothing twice or up to its last sent id."""
    clients = _clients(s)
    every = s.stream_messages.join(clients, "stream_name").select("client", "stream_name", "msg_id")
    return fanout.replay_then_live(every.where("msg_id <= 3"), every.where("msg_id > 1"), clients)


@query("SELECT o_orderkey AS client, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN o_custkey + 9 ELSE o_custkey + 7 END AS cursor FROM orders")
def write_ack(s: Source) -> DataFrame:
    """Cursors after a write: dead connections keep theirs, fully filtered batches reach their end, others what was written."""
    key, last = F.col("o_orderkey"), F.col("o_custkey")
    kept = F.when(key % 3 == 0, 0).otherwise(2)
    rows = s.orders.select(key.alias("client"), (key % 5 != 0).alias("alive"), kept.alias("kept"), (last + 9).alias("batch_max"), F.when(kept > 0, last + 7).alias("written_max"), last.alias("last_sent"))
    return fanout.acknowledged(rows)


@query("""WITH RECURSIVE first AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1),
    hops AS (SELECT * FROM first UNION ALL SELECT h.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = h.user_id AND e.ts >= h.ts + INTERVAL 3600 SECOND) FROM hops h WHERE h.ts IS NOT NULL)
    SELECT h.user_id, h.ts + INTERVAL 3600 SECOND AS flushed_at, arg_max(e.event_id, (e.ts, e.event_id)) AS event_id FROM hops h JOIN events e ON e.user_id = h.user_id AND e.ts >= h.ts AND e.ts < h.ts + INTERVAL 3600 SECOND
    WHERE h.ts IS NOT NULL GROUP BY 1, 2""")
def broadcast_coalescing(s: Source) -> DataFrame:
    """The last frame of each window, which its first frame opens."""
    return fanout.coalesced(s.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 3600).select("user_id", "event_id", "flushed_at")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN ts ELSE ts + INTERVAL 5 SECOND END AS sent_at FROM events WHERE user_id % 3 <> 1")
def deferred_broadcasts(s: Source) -> DataFrame:
    """Broadcasts outside (0) and inside transactions that commit (2) or roll back (1)."""
    tx = F.when(F.col("user_id") % 3 > 0, F.col("event_id"))
    rows = s.events.select("event_id", F.col("ts").alias("at"), tx.alias("tx_id"))
    done = s.events.where("user_id % 3 > 0").select(F.col("event_id").alias("tx_id"), F.when(F.col("user_id") % 3 == 2, F.col("ts") + F.expr("INTERVAL 5 SECOND")).alias("committed_at"))
    return fanout.deferred(rows, done).select("event_id", "sent_at")


_MEMBERS = "SELECT stream_name, member_id, 'm' || member_id AS metadata, min(seen_at) AS joined_at, max(seen_at) AS last_seen_at FROM presence WHERE event_type <> 'signup' GROUP BY 1, 2"


def _members(s: Source) -> DataFrame:
    own = s.presence.where("event_type <> 'signup'").groupBy("stream_name", "member_id")
    return own.agg(F.concat(F.lit("m"), F.first("member_id")).alias("metadata"), F.min("seen_at").alias("joined_at"), F.max("seen_at").alias("last_seen_at"))


@query(f"""SELECT coalesce(m.stream_name, j.stream_name) AS stream_name, coalesce(m.member_id, j.member_id) AS member_id, CASE WHEN j.member_id IS NOT NULL THEN 'new' ELSE m.metadata END AS metadata,
    coalesce(m.joined_at, {_T}) AS joined_at, CASE WHEN j.member_id IS NOT NULL THEN {_T} ELSE m.last_seen_at END AS last_seen_at
    FROM ({_MEMBERS}) m FULL JOIN (SELECT DISTINCT stream_name, CASE WHEN event_id % 2 = 0 THEN member_id ELSE 'x' || member_id END AS member_id FROM presence WHERE event_type = 'signup') j ON j.stream_name = m.stream_name AND j.member_id = m.member_id""")
def presence_join(s: Source) -> DataFrame:
    """Members after joins of known and unknown ones."""
    joins = s.presence.where("event_type = 'signup'").select("stream_name", F.when(F.col("event_id") % 2 == 0, F.col("member_id")).otherwise(F.concat(F.lit("x"), "member_id")).alias("member_id"), F.lit("new").alias("metadata"))
    return fanout.members_after(_members(s), joins, NOW)


@query(f"""SELECT stream_name, count(*) AS members, count(*) FILTER (WHERE last_seen_at = {_T}) AS touched FROM (SELECT m.stream_name, CASE WHEN t.member_id IS NOT NULL THEN {_T} ELSE m.last_seen_at END AS last_seen_at
    FROM ({_MEMBERS}) m LEFT JOIN (SELECT DISTINCT stream_name, member_id FROM presence WHERE event_type = 'signup') t ON t.stream_name = m.stream_name AND t.member_id = m.member_id) x WHERE last_seen_at >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
def presence_touch(s: Source) -> DataFrame:
    """By stream the members left after some were heard of and the idle ones swept."""
    touched = fanout.members_touched(_members(s), s.presence.where("event_type = 'signup'"), NOW)
    _, rest = fanout.members_swept(touched, "2024-01-30 12:00:00")
    return rest.groupBy("stream_name").agg(F.count("*").alias("members"), F.count_if(F.col("last_seen_at") == times.moment(NOW)).alias("touched"))


@query(f"SELECT stream_name, member_id, metadata, joined_at FROM ({_MEMBERS}) m WHERE (stream_name, member_id) IN (SELECT (stream_name, member_id) FROM presence WHERE event_type = 'error')")
def presence_leave(s: Source) -> DataFrame:
    """Members that leave, as they were; who was not there is not told of."""
    return fanout.members_left(_members(s), s.presence.where("event_type = 'error'"))[0].select("stream_name", "member_id", "metadata", "joined_at")


@query("SELECT user_id, event_id FROM (SELECT *, sum(event_id % 4) OVER w AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)) e WHERE total <= 10 OR r = 1")
def backpressure(s: Source) -> DataFrame:
    return fanout.newest_within(s.events.withColumn("frames", F.col("event_id") % 4), "user_id", "event_id", "frames", 10).select("user_id", "event_id")


@query(f"SELECT stream_name, member_id, seen_at FROM (SELECT stream_name, member_id, max(seen_at) AS seen_at, arg_max(event_type, event_id) AS last FROM presence GROUP BY 1, 2) p WHERE last <> 'error' AND seen_at >= {_T} - INTERVAL 90000 SECOND")
def presence_members(s: Source) -> DataFrame:
    return fanout.presence(s.presence, NOW, 90_000, F.col("event_type") == "error")


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600 THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY 1, 2) c GROUP BY 1")
def idle_sessions(s: Source) -> DataFrame:
    return fanout.sessions(s.events, "user_id", "ts", 3600).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT DISTINCT queue_name, msg_id // 100 AS batch FROM queue_messages")
def wake_coalescing(s: Source) -> DataFrame:
    return fanout.wakes(s.queue_messages, F.floor(F.col("msg_id") / 100))


@query("""WITH RECURSIVE first AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1),
    hops AS (SELECT * FROM first UNION ALL SELECT h.event_type, (SELECT min(e.ts) FROM events e WHERE e.event_type = h.event_type AND e.ts >= h.ts + INTERVAL 7200 SECOND) FROM hops h WHERE h.ts IS NOT NULL)
    SELECT event_type, ts FROM hops WHERE ts IS NOT NULL""")
def notify_throttle(s: Source) -> DataFrame:
    return live.throttled_batch(s.events, "event_type", "ts", 7_200_000)


@query(f"SELECT id, CASE WHEN epoch({_T} - last_heartbeat_at) >= 86500 THEN 'close' WHEN epoch({_T} - loop_tick_at) >= 86450 THEN 'beat' ELSE 'none' END AS action FROM processes")
def heartbeats(s: Source) -> DataFrame:
    """What the heartbeat does for each connection."""
    rows = s.processes.select("id", F.col("last_heartbeat_at").alias("last_used_at"), F.col("loop_tick_at").alias("last_write_at"))
    return fanout.beats(rows, NOW, 86_450, 86_500).select("id", "action")


@query("SELECT stream_name, count(*) AS n, round(avg(octet_length(encode(payload))), 4) AS mean_bytes, round(quantile_cont(octet_length(encode(payload)), 0.95), 4) AS p95_bytes FROM stream_messages GROUP BY 1")
def stream_bytes(s: Source) -> DataFrame:
    return stats.byte_distributions(s.stream_messages, "stream_name", "payload")
