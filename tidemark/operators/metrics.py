"""Queue depth and age, dashboards over them, and the health verdict."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import names, times, values


def queue_metrics(messages: DataFrame, as_of: str, catalog: DataFrame | None = None) -> DataFrame:
    """One row for each queue, in one aggregate; queues of the catalog without messages get zeros and nulls.

    length, visible, unread and parked counts; ages in whole seconds of the newest and oldest
    message and of the longest claimable one (by vt); the most reads; the highest id so far.
    """
    now = times.moment(as_of)
    open_ = F.col("vt") <= now
    out = messages.groupBy("queue_name").agg(
        F.count("*").alias("length"),
        F.count_if(open_).alias("visible"),
        F.count_if(open_ & (F.col("read_ct") == 0)).alias("visible_unread"),
        times.age_seconds(as_of, F.max("enqueued_at")).alias("newest_age_s"),
        times.age_seconds(as_of, F.min("enqueued_at")).alias("oldest_age_s"),
        times.age_seconds(as_of, F.min(F.when(open_, F.col("vt")))).alias("oldest_claimable_s"),
        F.max("read_ct").alias("max_read_ct"),
        F.max("msg_id").alias("total_messages"),
    )
    if catalog is not None:
        out = catalog.select("queue_name").join(out, "queue_name", "left").fillna(0, ["length", "visible", "visible_unread", "total_messages"])
    return out.withColumn("parked", F.col("length") - F.col("visible"))


def dashboard(metrics: DataFrame) -> DataFrame:
    """Totals over queues; depth and visible include dead letters, as the dashboard's do."""
    dead = names.is_dead_letters(F.col("queue_name"))
    return metrics.agg(
        F.count("*").alias("queues"),
        F.sum("length").alias("total_depth"),
        F.sum("visible").alias("total_visible"),
        F.coalesce(F.sum(F.when(dead, F.col("length"))), F.lit(0).cast("long")).alias("dlq_depth"),
        F.count_if(dead).alias("dlq_queues"),
    )


def paused_flags(metrics: DataFrame, states: DataFrame) -> DataFrame:
    """Queues with paused; states go by logical name, absent ones are not paused."""
    marks = states.select(F.col("queue_name").alias("state_name"), "paused")
    own = metrics.withColumn("state_name", names.logical(F.col("queue_name")))
    return own.join(marks, "state_name", "left").withColumn("paused", F.coalesce("paused", F.lit(False))).drop("state_name")


def table_health(tables: DataFrame) -> DataFrame:
    """Totals over tables of live and dead rows; tables without counts are left out."""
    known = tables.where("live IS NOT NULL OR dead IS NOT NULL").fillna(0, ["live", "dead"])
    bloat = values.ratio(F.col("dead"), F.col("live") + F.col("dead"))
    vacuum = [F.max("last_vacuum_s").alias("oldest_vacuum_s")] if "last_vacuum_s" in tables.columns else []
    return known.withColumn("bloat", bloat).agg(
        F.sum("dead").alias("dead"), F.sum("live").alias("live"), F.max("bloat").alias("worst_bloat"), F.count_if(F.col("bloat") > 0.1).alias("bloated"), *vacuum
    )


def gauges(metrics: DataFrame, processes: DataFrame, summary: DataFrame, streams: DataFrame) -> DataFrame:
    """(gauge, tag, value) of all that a probe reports: by queue, by host, of the whole and of streams. Gauges without a value are left out; the latency of a queue
    that only holds parked messages is 0.
    """
    number = lambda c: F.col(c).cast("double")
    by_queue = {
        "queue_depth": number("length"),
        "queue_visible_depth": number("visible"),
        "queue_paused": F.col("paused").cast("int").cast("double"),
        "queue_oldest_message_age_seconds": number("oldest_age_s"),
        "queue_oldest_claimable_age_seconds": number("oldest_claimable_s"),
        "queue_latency": F.coalesce(number("oldest_claimable_s"), F.lit(0.0)) * 1000,
    }
    parts = [
        metrics.select(F.concat(F.lit("queue:"), "queue_name").alias("tag"), *[c.alias(k) for k, c in by_queue.items()]).unpivot("tag", list(by_queue), "gauge", "value"),
        processes.groupBy(F.concat(F.lit("hostname:"), "hostname").alias("tag")).agg(F.count("*").cast("double").alias("value")).withColumn("gauge", F.lit("active_processes")),
    ]
    for rows in (summary, streams):
        columns = rows.columns
        parts.append(rows.select(F.lit("").alias("tag"), *[number(c).alias(c) for c in columns]).unpivot("tag", columns, "gauge", "value"))
    out = parts[0].select("gauge", "tag", "value")
    for rows in parts[1:]:
        out = out.unionByName(rows.select("gauge", "tag", "value"))
    return out.where("value IS NOT NULL")


def peer_priority(workers: DataFrame, as_of: str, alive_s: int = 300) -> DataFrame:
    """By worker the highest priority of other live workers that share a queue with it, 0 if none does. workers: id, queues, priority, last_heartbeat_at.

    Each queue's two highest priorities tell it of all: the highest unless that is the worker's own.
    """
    live = workers.where(F.col("last_heartbeat_at") > times.ago(as_of, alive_s))
    each = live.select("id", "priority", F.explode("queues").alias("queue"))
    top = each.groupBy("queue").agg(F.max(F.struct("priority", "id")).alias("first"))
    rest = each.join(top, "queue").where(F.col("id") != F.col("first.id")).groupBy("queue").agg(F.max("priority").alias("second"))
    known = top.join(rest, "queue", "left")
    own = workers.select("id", F.explode("queues").alias("queue")).join(known, "queue", "left")
    seen = F.when(F.col("first.id") != F.col("id"), F.col("first.priority")).otherwise(F.col("second"))
    return own.groupBy("id").agg(F.greatest(F.lit(0), F.coalesce(F.max(seen), F.lit(0))).alias("max_priority"))


def vacuum_candidates(tables: DataFrame, threshold: float = 0.1) -> DataFrame:
    total = F.col("live") + F.col("dead")
    return tables.where((total > 0) & (F.col("dead") / total > threshold)).orderBy(F.desc("dead"))


def process_status(processes: DataFrame, as_of: str, stale_s: int = 300, stall_s: dict[str, int] | None = None, default_stall_s: int = 90) -> DataFrame:
    """stale if the heartbeat is old; else stalled if the loop ticked too long ago for its kind; else healthy."""
    limit = F.lit(default_stall_s)
    for kind, seconds in (stall_s or {}).items():
        limit = F.when(F.col("kind") == kind, seconds).otherwise(limit)
    loop_age = times.seconds_between(times.moment(as_of), F.col("loop_tick_at"))
    status = F.when(times.seconds_between(times.moment(as_of), F.col("last_heartbeat_at")) > stale_s, "stale").when(loop_age > limit, "stalled").otherwise("healthy")
    return processes.withColumn("status", status)


def watchdog(ages: list[Column], threshold: float) -> Column:
    """Stalled only if the youngest known age is beyond the threshold; nothing known is not stalled."""
    return F.coalesce(F.least(*ages) > threshold, F.lit(False)) if len(ages) > 1 else F.coalesce(ages[0] > threshold, F.lit(False))


#: The kinds of processes that claim, how many queues a reason names, and the reasons' texts.
DRAINING = ("worker", "consumer")
SHOWN = 10
STALLED_REASONS = {
    "standing": "{stalled_workers} worker(s) stalled (heart-beating but claim loop not advancing) while {active_n} queue(s) have visible backlog: {active_names}",
    "unclaimed": "{unclaimed_n} queue(s) have visible messages with read_ct=0 (never claimed) while {drainers} draining process(es) are alive: {unclaimed_names}",
}
DEGRADED_REASONS = {
    "stale": "{stale_processes} process(es) stale (no recent heartbeat)",
    "held": "{held_n} paused queue(s) holding a backlog: {held_names}",
    "undrained": "{undrained_n} queue(s) hold messages but no capsule is configured to drain them: {undrained_names}",
    "dead": "{dead_n} dead-letter queue(s) hold messages",
    "old": "oldest open transaction is {oldest_transaction_s}s old (MVCC horizon pinning risk)",
    "unregistered": "{unregistered} unregistered stream queue(s) detected (dormant pre-registry durable streams)",
}


def filled(text: str) -> Column:
    """A text with the columns it names in braces."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def reasons(texts: dict[str, str], hold: dict[str, Column]) -> Column:
    """The texts whose condition holds, in their order."""
    return F.filter(F.array(*[F.when(hold[name], filled(text)) for name, text in texts.items()]), lambda x: x.isNotNull())


def _listed(rows: DataFrame, flag: str, prefix: str) -> list[Column]:
    """Aggregates over queues: how many have the flag, and their names in order, ten at most. One row for each queue is all that is gathered."""
    names_of = F.array_sort(F.collect_list(F.when(F.col(flag), F.col("queue_name"))))
    n = F.count_if(F.col(flag))
    shown = F.array_join(F.slice(names_of, 1, SHOWN), ", ")
    return [n.alias(f"{prefix}_n"), F.concat(shown, F.when(n > SHOWN, F.concat(F.lit(" (+"), (n - SHOWN).cast("string"), F.lit(" more)"))).otherwise("")).alias(f"{prefix}_names")]


def verdict(
    queues: DataFrame, processes: DataFrame, streams: DataFrame, drained: DataFrame | None = None, oldest_transaction_s: Column | None = None, unregistered: Column | None = None
) -> DataFrame:
    """One row: status (STALLED, DEGRADED or OK), reasons, and what they were drawn from.

    queues: queue_name, length, visible, visible_unread and paused; processes: kind and status; streams: queue_name. Dead-letter and
    stream queues are no work. A queue with visible messages has a backlog, a paused one's is not active. drained: the queues
    that some process is set to claim from; without it all are.

    STALLED: a worker's loop stands while there is an active backlog; or else draining processes are alive and a drained queue has
    visible messages that nobody ever claimed. DEGRADED: stale processes, paused backlogs, active backlogs nobody drains, dead letters, a
    transaction open for over 300 s, unregistered streams.
    """
    dead = names.is_dead_letters(F.col("queue_name"))
    known = streams.select("queue_name", F.lit(True).alias("is_stream")).distinct()
    own = queues.join(known, "queue_name", "left").withColumn("work", ~dead & F.col("is_stream").isNull())
    if drained is not None:
        own = own.join(drained.select("queue_name", F.lit(True).alias("has_drain")).distinct(), "queue_name", "left").withColumn("has_drain", F.coalesce("has_drain", F.lit(False)))
    else:
        own = own.withColumn("has_drain", F.lit(True))
    own = own.withColumn("backlog", F.col("work") & (F.col("visible") > 0)).withColumns(
        {
            "active": F.col("backlog") & ~F.col("paused"),
            "held": F.col("backlog") & F.col("paused"),
            "dead": dead & (F.col("length") > 0),
        }
    )
    own = own.withColumns({"unclaimed": F.col("active") & F.col("has_drain") & (F.col("visible_unread") > 0), "undrained": F.col("active") & ~F.col("has_drain")})
    flags = {"active": "active", "held": "held", "unclaimed": "unclaimed", "undrained": "undrained", "dead": "dead"}
    load = own.agg(
        *[c for flag, prefix in flags.items() for c in _listed(own, flag, prefix)],
        F.count("*").alias("queues"),
        F.coalesce(F.sum(F.when(F.col("work"), F.col("visible"))), F.lit(0)).alias("total_visible"),
        F.coalesce(F.sum(F.when(F.col("work"), F.col("length"))), F.lit(0)).alias("total_depth"),
    )
    worker = F.col("kind") == "worker"
    crew = processes.agg(
        F.count_if(worker).alias("workers"),
        F.count_if(worker & (F.col("status") == "stalled")).alias("stalled_workers"),
        F.count_if(F.col("kind").isin(*DRAINING) & F.col("status").isin("healthy", "stalled")).alias("drainers"),
        F.count_if(F.col("status") == "stale").alias("stale_processes"),
    )
    # two frames of one row each
    one = load.join(F.broadcast(crew)).withColumns({"oldest_transaction_s": oldest_transaction_s if oldest_transaction_s is not None else F.lit(None).cast("long"), "unregistered": unregistered if unregistered is not None else F.lit(0)})
    some = lambda c: F.col(c) > 0
    standing = some("stalled_workers") & some("active_n")
    stalled = reasons(STALLED_REASONS, {"standing": standing, "unclaimed": ~standing & some("drainers") & some("unclaimed_n")})
    degraded = reasons(
        DEGRADED_REASONS,
        {"stale": some("stale_processes"), "held": some("held_n"), "undrained": some("undrained_n"), "dead": some("dead_n"), "old": F.col("oldest_transaction_s") > 300, "unregistered": some("unregistered")},
    )
    one = one.withColumns({"stalled": stalled, "degraded": degraded})
    status = F.when(F.size("stalled") > 0, "STALLED").when(F.size("degraded") > 0, "DEGRADED").otherwise("OK")
    summary = ("queues", "total_visible", "total_depth", "workers", "stalled_workers", "stale_processes", "oldest_transaction_s")
    return one.select(status.alias("status"), F.concat("stalled", "degraded").alias("reasons"), *summary)


def check_status(verdict: Column) -> Column:
    return F.when(verdict == "STALLED", "fail").when(verdict == "DEGRADED", "warn").otherwise("ok")


def readiness(booted: Column, draining: Column, live: Column, expected: Column) -> Column:
    return F.when(draining, "DRAINING").when(~booted, "BOOTING").when(live >= expected, "OK").otherwise("DEGRADED")


def http_status(state: Column) -> Column:
    return F.when(state.isin("OK", "DEGRADED"), 200).otherwise(503)


def listen_connections(scope: Column, capsules: Column, consumers: Column) -> Column:
    """Connections for notifications: none where they are off, one that all share if there is anyone to share it, or one each."""
    each = capsules + consumers
    return F.when(scope == "off", 0).when(scope == "shared", F.least(each, F.lit(1))).otherwise(each)


def pool_size(capsules: DataFrame, async_threads: int = 3) -> DataFrame:
    """Connections that a process needs: threads of all capsules (async ones count flat), a dispatcher and a scheduler."""
    return capsules.agg((F.sum(F.when(F.col("mode") == "async", async_threads).otherwise(F.col("threads"))) + 2).alias("connections"))


#: Fixed values of pool sizing: when to grow and shrink, a process's claim on free connections, the most that one step adds, and the margins.
GROW_AT, SHRINK_UNDER = 0.85, 0.30
CLAIM, PEER_WEIGHT, STEP = 0.25, 1.5, 4
MARGIN, MARGIN_LEAST = 0.05, 5
RESERVE, RESERVE_LEAST = 0.20, 20


def autoscale(size: Column, available: Column, limit: Column, used: Column, peers: Column, baseline: Column, most: Column, may_shrink: Column | None = None) -> Column:
    """(action, size) of a pool after one look at it. limit, used, peers: the server's connections; null if they could not be read.

    Few connections left at the server bring the pool to its baseline at once. Else a busy pool grows by its claim on a fair share of
    them, and an idle one (where may_shrink) falls by a step towards the baseline.
    """
    free = limit - used
    margin = F.greatest(F.lit(MARGIN_LEAST), F.ceil(limit * MARGIN))
    reserve = F.greatest(F.lit(RESERVE_LEAST), F.ceil(limit * RESERVE))
    busy = (size - available) / size
    fair = free / (F.greatest(F.coalesce(peers, F.lit(0)), F.lit(1)) * PEER_WEIGHT)
    step = F.least(F.floor(fair * CLAIM), F.lit(STEP), F.floor(free / 2))
    grown = F.least(size + step, most)  # least() skips a null: no upper limit
    known = size.isNotNull() & available.isNotNull() & (size > 0)
    may_grow = (free > reserve) & (size > 1) & (step >= 1) & (grown > size)
    idle = (busy < SHRINK_UNDER) & (size > baseline) & (F.lit(True) if may_shrink is None else may_shrink)
    hold = F.struct(F.lit("hold").alias("action"), size.cast("long").alias("size"))
    act = lambda name, to: F.struct(F.lit(name).alias("action"), to.cast("long").alias("size"))
    calm = F.when(~known, hold).when(busy >= GROW_AT, F.when(may_grow, act("grow", grown)).otherwise(hold)).when(idle, act("shrink", F.greatest(baseline, size - STEP))).otherwise(hold)
    short = F.when(F.coalesce(size, F.lit(0)) > baseline, act("emergency_shrink", baseline)).otherwise(hold)
    return F.when(limit.isNull() | used.isNull(), hold).when(free < margin, short).otherwise(calm)


def snapshot_rates(snapshots: DataFrame, key: str, at: str, count: str) -> DataFrame:
    """Change of a count per second since the snapshot before, to one place; 0.0 for the first."""
    order = Window.partitionBy(key).orderBy(at)
    seconds = times.seconds_between(F.col(at), F.lag(at).over(order))
    rate = F.round((F.col(count) - F.lag(count).over(order)) / seconds, 1)
    return snapshots.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
