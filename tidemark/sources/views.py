"""Message-log tables read out of plain business tables.

Each view is one SELECT that Spark and DuckDB both accept; ``spark_view`` builds it as a DataFrame,
``duck_view`` gives its text. Timestamps carry no zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-01-31 00:00:00"

_K = "(SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e"

VIEWS: dict[str, str] = {
    "queue_messages": f"""SELECT event_id AS msg_id,
       CASE event_type WHEN 'click' THEN 'mq_default' WHEN 'view' THEN 'mq_low' WHEN 'purchase' THEN 'mq_billing'
            WHEN 'signup' THEN 'mq_mailers' ELSE 'mq_default_dlq' END AS queue_name,
       k % 7 AS read_ct, ts AS enqueued_at,
       CASE WHEN k % 10 = 0 THEN TIMESTAMP_NTZ '2024-01-31 01:00:00' ELSE ts + INTERVAL 30 SECOND END AS vt,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS group_key,
       concat(event_type, '.u', CAST(user_id AS STRING), CASE WHEN k % 2 = 0 THEN '.retry' ELSE '' END) AS routing_key,
       props AS message,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat(chr(123), '"x-fifo-group":"u', CAST(user_id AS STRING), '"', chr(125)) END AS headers FROM {_K}""",
    "job_stats": f"""SELECT event_id AS id, concat(event_type, '_job') AS job_class, concat('mq_q', CAST(user_id % 4 AS STRING)) AS queue_name,
       CASE WHEN k % 20 = 0 THEN 'dead_lettered' WHEN k % 20 < 3 THEN 'failed' ELSE 'success' END AS status,
       CAST(round(value * 10) AS BIGINT) AS duration_ms,
       CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k * 13 + event_id % 97 AS BIGINT) END AS enqueue_latency_ms,
       k % 4 AS retry_count, ts AS created_at FROM {_K}""",
    "stream_stats": """SELECT concat('room:', CAST(user_id AS STRING)) AS stream_name,
       CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' ELSE 'broadcast' END AS event_type,
       CAST(round(value) AS BIGINT) AS duration_ms,
       CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE CAST(event_id % 13 AS INT) END AS fanout, ts AS created_at FROM {events}""",
    "batch_jobs": """SELECT o_orderkey AS batch_id, l_linenumber AS job_no,
       CASE WHEN l_returnflag = 'R' THEN 'discarded' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS outcome
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "outbox_entries": """SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('mq_', lower(substr(o_orderpriority, 3))) END AS queue_name,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('orders.', lower(o_orderstatus)) ELSE NULL END AS routing_key,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 2 * 10 AS INT) AS delay,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS published_at, o_orderdate AS created_at FROM {orders}""",
    "processes": """SELECT user_id AS id, CASE user_id % 4 WHEN 0 THEN 'worker' WHEN 1 THEN 'consumer' WHEN 2 THEN 'dispatcher' ELSE 'scheduler' END AS kind,
       concat('host', CAST(user_id % 3 AS STRING)) AS hostname, max(ts) AS last_heartbeat_at,
       max(CASE WHEN event_type <> 'error' THEN ts END) AS loop_tick_at FROM {events} GROUP BY user_id""",
    "processed_events": """SELECT CAST(event_id AS STRING) AS event_id, concat(event_type, '_handler') AS handler_class, ts AS processed_at,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts + INTERVAL 1 SECOND END AS completed_at FROM {events}""",
    "stream_messages": """SELECT concat('conv:', CAST(conv_id AS STRING)) AS stream_name, turn AS msg_id, role, text AS payload,
       CASE WHEN turn % 2 = 0 THEN 'live' ELSE 'archive' END AS source FROM {conversations}""",
    "topic_bindings": """SELECT pattern, queue_name, concat('^', replace(replace(replace(pattern, '.', '[.]'), '*', '[^.]+'), '#', '.*'), '$') AS compiled_regex
FROM (VALUES ('click.*', 'q_click'), ('purchase.#', 'q_purchase'), ('#.retry', 'q_retry'), ('#', 'q_all'), ('*.u1', 'q_all'), ('signup.u2.#', 'q_signup')) AS b(pattern, queue_name)""",
    "queue_states": """SELECT * FROM (VALUES ('default', true), ('billing', false)) AS s(queue_name, paused)""",
    "stream_queues": """SELECT * FROM (VALUES ('mq_mailers')) AS s(queue_name)""",
    "failed_events": f"""SELECT event_id AS msg_id, concat('mq_', event_type) AS queue_name, concat('Error', CAST(k % 5 AS STRING)) AS error_class,
       props AS error_message, ts AS failed_at FROM {_K} WHERE k % 6 = 0""",
    "locks": f"""SELECT concat('lock', CAST(event_id % 500 AS STRING)) AS lock_key, event_id AS msg_id, user_id, ts AS created_at FROM {_K} WHERE k % 3 = 0""",
    "blocked": f"""SELECT event_id AS id, concat('key', CAST(user_id AS STRING)) AS concurrency_key, k % 5 AS priority, ts AS created_at,
       ts + INTERVAL 20 DAY AS expires_at FROM {_K} WHERE event_type = 'click'""",
    "presence": """SELECT concat('room:', CAST(user_id % 20 AS STRING)) AS stream_name, concat('m', CAST(user_id AS STRING)) AS member_id,
       event_type, event_id, ts AS seen_at FROM {events}""",
}

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def duck_view(name: str) -> str:
    text = VIEWS[name].replace("TIMESTAMP_NTZ", "TIMESTAMP")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_views(sql: str) -> str:
    """sql after a WITH clause for the views it names; a query's own WITH is taken on."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = ", ".join(f"{v} AS ({duck_view(v)})" for v in used)
    if not parts:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own[1] or ''}{parts}, {sql[own.end() :]}" if own else f"WITH {parts} {sql}"


class Source:
    """The tables of a folder and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        needs = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
        return self.spark.sql(VIEWS[name], **needs)
