"""Queries over scalar functions and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, payloads, times, values
from tidemark.operators import claims, metrics, stats
from tidemark.plans.registry import query
from tidemark.sources import queues, sinks
from tidemark.sources.views import NOW, Source
from tidemark.streaming import fanout

_T = f"TIMESTAMP '{NOW}'"


@query("SELECT queue_name, regexp_replace(regexp_replace(queue_name, '^mq_', ''), '_p[0-9]+$', '') AS logical, queue_name || '_dlq' AS dlq, queue_name || '_p2' AS sub, queue_name || '_p0' AS low FROM (SELECT DISTINCT queue_name FROM queue_messages) q")
def queue_names(s: Source) -> DataFrame:
    q = F.col("queue_name")
    return s.queue_messages.select("queue_name").distinct().select(
        "queue_name", names.logical(q).alias("logical"), names.dead_letters(q).alias("dlq"), names.with_priority(q, F.lit(9), 3).alias("sub"), names.with_priority(q, F.lit(-1), 3).alias("low")
    )


_ODD_NAMES = """SELECT DISTINCT replace(c_mktsegment, 'U', 'u__') || CASE c_custkey % 6 WHEN 0 THEN '_x_' WHEN 1 THEN '-a.b' WHEN 2 THEN '::Z' WHEN 3 THEN ' é!' WHEN 4 THEN '_-_9-' ELSE repeat('y', 60) END AS name FROM customer"""


def _odd_names(s: Source) -> DataFrame:
    kind = F.col("c_custkey") % 6
    end = F.when(kind == 0, "_x_").when(kind == 1, "-a.b").when(kind == 2, "::Z").when(kind == 3, " é!").when(kind == 4, "_-_9-").otherwise("y" * 60)
    return s.customer.select(F.concat(F.replace("c_mktsegment", F.lit("U"), F.lit("u__")), end).alias("name")).distinct()


@query(f"""SELECT name, normal, length(normal) <= 47 AND regexp_full_match(normal, '[A-Za-z0-9_]+') AS valid FROM (SELECT name, CASE WHEN regexp_full_match(name, '[A-Za-z0-9_]+') THEN name
    ELSE trim(regexp_replace(regexp_replace(regexp_replace(name, '[-.:]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') END AS normal FROM ({_ODD_NAMES}) p) n""")
def normalize_names(s: Source) -> DataFrame:
    """Names as queues bear them: good ones, runs of underscores too, stay as they are."""
    rows = _odd_names(s).withColumn("normal", names.normalize(F.col("name")))
    return rows.withColumn("valid", names.valid_name(F.col("normal")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'order_placed' WHEN 1 THEN 'billing_http' WHEN 2 THEN 'a1' ELSE 'v2_api' END || '_' || lower(o_orderstatus) || CASE WHEN o_orderkey % 2 = 0 THEN '_handler' ELSE 'x_job' END AS queue FROM orders""")
def handler_queues(s: Source) -> DataFrame:
    """Queues named after handler classes such as Billing::HTTPOx::Job."""
    first = F.element_at(F.array(*map(F.lit, ("OrderPlaced", "Billing::HTTP::", "A1", "V2API::"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    last = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("Handler"))).otherwise(F.concat("o_orderstatus", F.lit("x::Job")))
    return s.orders.select("o_orderkey", names.handler_queue(F.concat(first, last)).alias("queue"))


@query("SELECT DISTINCT queue_name, substr(sha256(queue_name), 1, 16) AS short_id FROM queue_messages")
def short_ids(s: Source) -> DataFrame:
    return s.queue_messages.select("queue_name").distinct().withColumn("short_id", values.short_id(F.col("queue_name")))


@query("SELECT DISTINCT p_name || e AS name, NOT regexp_matches(p_name || e, '[$;'']|--') AS ok FROM part, (VALUES (''), ('$'), (';x'), (chr(39) || 's'), ('--'), ('-_-')) v(e)")
def table_names(s: Source) -> DataFrame:
    ends = s.spark.createDataFrame([("",), ("$",), (";x",), ("'s",), ("--",), ("-_-",)], "e string")
    rows = s.part.select("p_name").join(F.broadcast(ends)).select(F.concat("p_name", "e").alias("name")).distinct()  # six rows
    return rows.withColumn("ok", names.table_name_ok(F.col("name")))


@query("""WITH RECURSIVE q AS (SELECT DISTINCT queue_name FROM queue_messages),
    step AS (SELECT queue_name, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM q UNION ALL
    SELECT queue_name, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM
    (SELECT queue_name, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(queue_name, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM step WHERE i < 8 * length(queue_name)) s)
    SELECT queue_name, xor(c, 4294967295) & 2147483647 AS id FROM step WHERE i = 8 * length(queue_name)""")
def lock_ids(s: Source) -> DataFrame:
    """The advisory lock of each queue: its checksum without the top bit."""
    return s.queue_messages.select("queue_name").distinct().withColumn("id", names.advisory_lock(F.col("queue_name")).cast("long"))


@query(f"SELECT event_id, CAST(round_even(epoch({_T} - ts), 0) AS BIGINT) AS age_s FROM events")
def age_seconds(s: Source) -> DataFrame:
    return s.events.select("event_id", times.age_seconds(NOW, F.col("ts")).alias("age_s"))


@query(f"""SELECT event_id, CASE WHEN a < 60 THEN CAST(a AS BIGINT) || 's ago' WHEN a < 3600 THEN CAST(floor(a / 60) AS BIGINT) || 'm ago' WHEN a < 86400 THEN CAST(floor(a / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(a / 86400) AS BIGINT) || 'd ago' END AS ago
    FROM (SELECT event_id, CAST(round_even(epoch({_T} - ts), 0) AS BIGINT) AS a FROM events) e""")
def time_ago(s: Source) -> DataFrame:
    return s.events.select("event_id", times.time_ago(times.age_seconds(NOW, F.col("ts"))).alias("ago"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1e6, 1)) || 'M' WHEN n >= 1000 THEN printf('%.1f', round(n / 1e3, 1)) || 'K' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT o_orderkey, o_orderkey * 37 AS n FROM orders) o")
def short_numbers(s: Source) -> DataFrame:
    return s.orders.select("o_orderkey", times.short_number(F.col("o_orderkey") * 37).alias("label"))


@query("SELECT id, CASE WHEN duration_ms < 1000 THEN duration_ms || 'ms' WHEN duration_ms < 60000 THEN printf('%.1f', round(duration_ms / 1000.0, 1)) || 's' ELSE 'long' END AS label FROM job_stats")
def ms_labels(s: Source) -> DataFrame:
    return s.job_stats.select("id", times.ms_duration(F.col("duration_ms")).alias("label"))


@query("SELECT event_id, CASE WHEN length(p) > 20 THEN substr(p, 1, 20) || '...' ELSE p END AS preview FROM (SELECT event_id, props || props || props AS p FROM events) e")
def json_preview(s: Source) -> DataFrame:
    return s.events.select("event_id", values.preview(F.concat("props", "props", "props"), 20).alias("preview"))


@query("SELECT msg_id, CAST(json_extract_string(message, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(headers, '$.x-fifo-group'), '_default_fifo_group') AS group_key FROM queue_messages")
def json_extract(s: Source) -> DataFrame:
    group = F.coalesce(queues.group_of(F.col("headers")), F.lit(claims.NO_GROUP))
    return s.queue_messages.select("msg_id", F.get_json_object("message", "$.k").cast("int").alias("k"), group.alias("group_key"))


@query("SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS k, event_type FROM events")
def json_build(s: Source) -> DataFrame:
    """Events built as JSON and unwrapped again; a body that is no JSON would pass through."""
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("props").alias("payload"), F.col("event_type").alias("routing_key")))
    read = s.events.select(F.from_json(body, "event_id string, payload string, routing_key string").alias("e"))
    return read.select(F.col("e.event_id").cast("long").alias("event_id"), F.regexp_extract("e.payload", "[0-9]+", 0).alias("k"), F.col("e.routing_key").alias("event_type"))


def _payload(s: Source) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    text = ['{"user": {"api_key":"k', key, '","id":', key, ',"keys":["a",{"Auth_Token":{"a":1,"b":[2]},"x":null}]},"note":"token=\\"abc\\", {\\"password\\":1}", "message":"m","payload":{"message":7,"arguments":null},"my-key":null,"list":["token"]}']
    whole = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in text])
    return s.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "no {json").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('[{"secret":'), key, F.lit("},[1.5]]"))).otherwise(whole).alias("payload"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no {json' WHEN 1 THEN '[{"secret":"[FILTERED]"},[1.5]]' ELSE
    '{"user":{"api_key":"[FILTERED]","id":' || o_orderkey || ',"keys":["a",{"Auth_Token":"[FILTERED]","x":null}]},"note":"token=' || chr(92) || '"abc' || chr(92) || '", {' || chr(92) || '"password' || chr(92) || '":1}","message":"m","payload":{"message":7,"arguments":null},"my-key":"[FILTERED]","list":["token"]}' END AS payload FROM orders""")
def payload_filter(s: Source) -> DataFrame:
    """Secrets masked by key at any depth, whatever is under the key; texts that only look like keys, and no JSON, stay."""
    return _payload(s).select("o_orderkey", payloads.filtered(F.col("payload")).alias("payload"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no {json' WHEN 1 THEN '[{"secret":' || o_orderkey || '},[1.5]]' ELSE
    '{"user":{"api_key":"k' || o_orderkey || '","id":' || o_orderkey || ',"keys":["a",{"Auth_Token":{"a":1,"b":[2]},"x":null}]},"note":"token=' || chr(92) || '"abc' || chr(92) || '", {' || chr(92) || '"password' || chr(92) || '":1}","message":"[redacted]","payload":{"message":"[redacted]","arguments":null},"my-key":null,"list":["token"]}' END AS payload FROM orders""")
def deep_redact(s: Source) -> DataFrame:
    """Message bodies masked: leaves under the body keys, not objects, lists or null."""
    return _payload(s).select("o_orderkey", payloads.redacted(F.col("payload")).alias("payload"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderstatus) WHEN 1 THEN 'a ' || lower(o_orderstatus) END AS event FROM orders")
def sse_events(s: Source) -> DataFrame:
    """Usable event names: stripped; blank ones and such of several lines count as none."""
    name = F.lower("o_orderstatus")
    kinds = [F.concat(F.lit("  "), name, F.lit(" ")), F.concat(F.lit("a "), name), F.lit("   "), F.concat(name, F.lit("\n"), name), F.concat(name, F.lit("\rx"))]
    return s.orders.select("o_orderkey", values.sse_event(F.element_at(F.array(*kinds), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("event"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN o_custkey WHEN 4 THEN 9223372036854775807 WHEN 5 THEN 0 END AS position FROM orders""")
def cursors(s: Source) -> DataFrame:
    """Positions from a header, which wins even if it is bad, or else a parameter."""
    key, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    header = F.when(kind == 0, key).when(kind == 2, F.concat(F.lit("-"), key)).when(kind == 3, "9223372036854775808").when(kind == 4, "9223372036854775807").when(kind == 5, "0")
    return s.orders.select("o_orderkey", values.cursor(header, F.col("o_custkey").cast("string")).alias("position"))


@query("SELECT stream_name, greatest(0, max(msg_id) - 2) AS since_id, 0 AS since_start, max(msg_id) AS since_mark FROM stream_messages GROUP BY 1")
def replay_start(s: Source) -> DataFrame:
    rows = s.stream_messages.groupBy("stream_name").agg(F.max("msg_id").alias("w"))
    start = lambda mode: values.replay_from(F.col("w"), F.lit(mode))
    return rows.select("stream_name", start("2").alias("since_id"), start("all").cast("int").alias("since_start"), start("watermark").alias("since_mark"))


@query("SELECT id, round(duration_ms / 1000.0, 4) AS duration_s FROM job_stats")
def ms_to_seconds(s: Source) -> DataFrame:
    return s.job_stats.select("id", values.ms_to_s(F.col("duration_ms")).alias("duration_s"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 0.3 ELSE 0.1 END AS poll_s FROM events")
def poll_backoff(s: Source) -> DataFrame:
    return s.events.select("event_id", F.round(values.poll_interval(F.lit(0.1), F.col("user_id") % 2 == 0), 4).alias("poll_s"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'A' ELSE o_orderpriority END AS component, CASE o_orderkey % 4 WHEN 0 THEN 'plain ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'started ' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'x' ELSE '[B] ' || CAST(o_custkey AS VARCHAR) END AS message,
    '{"severity":"INFO","component":' || CASE o_orderkey % 4 WHEN 0 THEN 'null' WHEN 3 THEN '"A"' ELSE '"' || o_orderpriority || '"' END || ',"message":"' || CASE o_orderkey % 4 WHEN 0 THEN 'plain ' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'started ' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'x' ELSE '[B] ' || CAST(o_custkey AS VARCHAR) END || '"}' AS json FROM orders""")
def log_lines(s: Source) -> DataFrame:
    kind, clerk, own = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string"), F.concat(F.lit("["), "o_orderpriority", F.lit("] "))
    line = F.when(kind == 0, F.concat(F.lit("plain "), clerk)).when(kind == 1, F.concat(own, F.lit("started "), clerk)).when(kind == 2, F.concat(own, F.lit("x"))).otherwise(F.concat(F.lit("[A] [B] "), clerk))
    rows = s.orders.select("o_orderkey", values.log_parts(line).alias("p")).select("o_orderkey", "p.*")
    return rows.withColumn("json", values.log_json(F.lit("INFO"), F.col("component"), F.col("message")))


@query("""SELECT n_nationkey, q AS queue_name, CASE WHEN q = 'low' THEN 1 ELSE 0 END AS capsule, CASE WHEN q = 'low' THEN 2 ELSE n_nationkey + 1 END AS threads, CAST(NULL AS VARCHAR) AS repeated
    FROM nation, (VALUES ('default'), ('mailers'), ('low')) v(q) WHERE n_nationkey % 4 <> 3 UNION ALL SELECT n_nationkey, NULL, NULL, NULL, 'default' FROM nation WHERE n_nationkey % 4 = 3""")
def capsule_strings(s: Source) -> DataFrame:
    """'q1,q2: n; q3: m' as rows of queue, capsule and threads; a spec that names a queue twice is refused, with the queue's name."""
    spec = F.concat(F.lit("default, mailers: "), (F.col("n_nationkey") + 1).cast("string"), F.when(F.col("n_nationkey") % 4 == 3, "; low,default: 2").otherwise("; low: 2"))
    rows = s.nation.select("n_nationkey", values.capsules(spec).alias("c")).select("n_nationkey", F.explode("c").alias("c"))
    return rows.select("n_nationkey", "c.queue_name", "c.capsule", "c.threads", "c.repeated")


@query("""SELECT *, CASE state WHEN 'OK' THEN 200 WHEN 'DEGRADED' THEN 200 ELSE 503 END AS code FROM (SELECT o_orderkey,
    CASE WHEN o_orderkey % 5 = 0 THEN 'DRAINING' WHEN o_orderkey % 7 = 0 THEN 'BOOTING' WHEN o_custkey % 4 >= o_orderkey % 3 THEN 'OK' ELSE 'DEGRADED' END AS state FROM orders) o""")
def readiness(s: Source) -> DataFrame:
    key = F.col("o_orderkey")
    rows = s.orders.select("o_orderkey", metrics.readiness(key % 7 != 0, key % 5 == 0, F.col("o_custkey") % 4, key % 3).alias("state"))
    return rows.withColumn("code", metrics.http_status(F.col("state")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey % 4 + c_custkey % 2 > 0 THEN 1 ELSE 0 END ELSE c_nationkey % 4 + c_custkey % 2 END AS connections FROM customer")
def listen_budget(s: Source) -> DataFrame:
    """Connections by scope, number of capsules and of consumers."""
    scope = F.element_at(F.array(F.lit("off"), F.lit("shared"), F.lit("fork")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return s.customer.select("c_custkey", metrics.listen_connections(scope, F.col("c_nationkey") % 4, F.col("c_custkey") % 2).alias("connections"))


@query("SELECT sum(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE c_nationkey END) + 2 AS connections FROM customer")
def pool_size(s: Source) -> DataFrame:
    """Connections for capsules, a quarter of them asynchronous."""
    return metrics.pool_size(s.customer.select(F.when(F.col("c_custkey") % 4 == 0, "async").otherwise("threads").alias("mode"), F.col("c_nationkey").alias("threads")))


_POOLS = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey % 14 END AS size, least(o_custkey % 14, o_orderkey % 13) AS available, 100 + o_custkey % 300 AS maxc,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE (o_orderkey * 7) % (90 + o_custkey % 300) + 10 END AS used, o_orderkey % 6 AS peers, 3 AS baseline,
    CASE WHEN o_custkey % 2 = 0 THEN 10 END AS cap, o_orderkey % 4 <> 1 AS may_shrink FROM orders"""


def _pools(s: Source) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return s.orders.select(
        "o_orderkey", F.when(key % 97 != 0, cust % 14).alias("size"), F.least(cust % 14, key % 13).alias("available"), (100 + cust % 300).alias("maxc"),
        F.when(key % 89 != 0, (key * 7) % (90 + cust % 300) + 10).alias("used"), (key % 6).alias("peers"), F.lit(3).alias("baseline"), F.when(cust % 2 == 0, 10).alias("cap"), (key % 4 != 1).alias("may_shrink"),
    )


@query(f"""SELECT o_orderkey, action, CAST(CASE action WHEN 'emergency_shrink' THEN baseline WHEN 'grow' THEN target WHEN 'shrink' THEN greatest(baseline, size - 4) ELSE size END AS BIGINT) AS size FROM (
    SELECT *, CASE WHEN maxc IS NULL OR used IS NULL THEN 'hold'
        WHEN free < margin THEN CASE WHEN coalesce(size, 0) > baseline THEN 'emergency_shrink' ELSE 'hold' END
        WHEN size IS NULL OR available IS NULL OR size <= 0 THEN 'hold'
        WHEN busy >= 0.85 THEN CASE WHEN free <= reserve OR size <= 1 OR delta < 1 OR target <= size THEN 'hold' ELSE 'grow' END
        WHEN may_shrink AND busy < 0.30 THEN CASE WHEN size <= baseline THEN 'hold' ELSE 'shrink' END ELSE 'hold' END AS action FROM (
    SELECT *, CASE WHEN cap IS NULL THEN size + delta ELSE least(size + delta, cap) END AS target FROM (
    SELECT *, least(floor(0.25 * (free / (greatest(peers, 1) * 1.5))), 4, free // 2) AS delta, CASE WHEN size > 0 THEN (size - available) / size END AS busy,
        greatest(5, ceil(0.05 * maxc)) AS margin, greatest(20, ceil(0.20 * maxc)) AS reserve FROM (SELECT *, maxc - used AS free FROM ({_POOLS}) p) a) b) c) d""")
def pool_autoscale(s: Source) -> DataFrame:
    c = F.col
    step = metrics.autoscale(c("size"), c("available"), c("maxc"), c("used"), c("peers"), c("baseline"), c("cap"), c("may_shrink"))
    return _pools(s).select("o_orderkey", step.alias("step")).select("o_orderkey", "step.action", "step.size")


_LENGTHS = "SELECT queue_name, count(*) AS length FROM queue_messages GROUP BY queue_name"


@query(f"""SELECT 0 AS place, '# HELP queue_depth Messages in queue' AS line UNION ALL SELECT 1, '# TYPE queue_depth gauge'
    UNION ALL SELECT 2, 'queue_depth{{queue_name="' || queue_name || '"}} ' || length FROM ({_LENGTHS}) l""")
def prometheus_text(s: Source) -> DataFrame:
    return sinks.prometheus_family(metrics.queue_metrics(s.queue_messages, NOW), "queue_depth", "gauge", "Messages in queue", "queue_name", "length")


@query(f"SELECT 'queue.depth:' || length || '|g|#queue:' || queue_name || ',env:test' AS line FROM ({_LENGTHS}) l")
def statsd_lines(s: Source) -> DataFrame:
    rows = metrics.queue_metrics(s.queue_messages, NOW)
    tags = F.array(F.concat(F.lit("queue:"), "queue_name"), F.lit("env:test"))
    return rows.select(sinks.statsd_line(F.lit("queue.depth"), F.col("length"), F.lit("g"), tags).alias("line"))


@query("SELECT stream_name, msg_id, 'id: ' || msg_id || chr(10) || 'event: ' || role || chr(10) || 'data: ' || replace(payload, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM stream_messages")
def sse_frames(s: Source) -> DataFrame:
    return s.stream_messages.select("stream_name", "msg_id", sinks.sse_frame(F.col("msg_id"), F.col("payload"), F.col("role")).alias("frame"))


@query("SELECT '{\"status\":\"' || status || '\",\"n\":' || count(*) || '}' AS json FROM job_stats GROUP BY status")
def json_api(s: Source) -> DataFrame:
    return sinks.json_rows(stats.counts_by(s.job_stats, "status"))


@query("SELECT event_id, CASE WHEN octet_length(encode(props)) > 9 THEN 'durable' ELSE 'notify' END AS route, 'durable' AS large FROM events")
def notify_cap(s: Source) -> DataFrame:
    """Payloads beyond the notification's limit (here 9 bytes, then the usual one) take the durable path."""
    return s.events.select("event_id", fanout.notify_route(F.col("props"), 9).alias("route"), fanout.notify_route(F.repeat("props", F.lit(8000))).alias("large"))


@query(f"""SELECT queue_name, gauge, value FROM (SELECT queue_name, 'queue_depth' AS gauge, CAST(count(*) AS DOUBLE) AS value FROM queue_messages GROUP BY 1
    UNION ALL SELECT queue_name, 'queue_latency_ms', coalesce(CAST(round_even(epoch({_T} - min(vt) FILTER (WHERE vt <= {_T})), 0) AS DOUBLE) * 1000, 0) FROM queue_messages GROUP BY 1) g""")
def probe_gauges(s: Source) -> DataFrame:
    rows = metrics.queue_metrics(s.queue_messages, NOW).select(
        "queue_name", F.col("length").cast("double").alias("queue_depth"), F.coalesce(F.col("oldest_claimable_s") * 1000, F.lit(0)).cast("double").alias("queue_latency_ms")
    )
    return rows.unpivot("queue_name", ["queue_depth", "queue_latency_ms"], "gauge", "value")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS status, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'b' END AS detail FROM orders")
def verdict_status(s: Source) -> DataFrame:
    """A check's status and its first reason."""
    status = F.element_at(F.array(F.lit("STALLED"), F.lit("DEGRADED"), F.lit("OK")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    reasons = F.when(status == "STALLED", F.array("o_orderpriority", F.lit("b"))).when(status == "DEGRADED", F.array(F.lit("b"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return s.orders.select("o_orderkey", metrics.check_status(status).alias("status"), F.get(reasons, F.lit(0)).alias("detail"))
