"""State machines over rows: idempotency, batches, locks, semaphores, breakers, retention, schedules.

Consecutive-failure streaks are gaps and islands: one window sort by key, no loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times, topics, values
from tidemark.operators import runs
from tidemark.operators.claims import numbered


def to_run(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Events that still need their handler: without a completed claim; a pending claim runs again."""
    done = processed.where("completed_at IS NOT NULL").select("event_id", "handler_class")
    return events.join(done, ["event_id", "handler_class"], "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def dedup_cache(events: DataFrame, cache: str, key: str, at: str, ttl_s: float = 300, max_size: int = 10_000) -> DataFrame:
    """Events that a cache of seen keys lets through, in time order (ties by the other columns).

    An event marks its key if it passes, and only then; the key is seen until more than ttl_s after that. A full cache
    forgets its oldest mark. ``cache`` names the process an event comes to, each with a cache of its own: its events stream through
    one task that holds max_size marks, never the events.
    """
    rest = [c for c in events.columns if c not in (cache, at)]
    dealt = events.withColumn("__us", times.micros(F.col(at))).repartition(F.col(cache)).sortWithinPartitions(cache, "__us", *rest)
    names = dealt.columns
    place = {c: names.index(c) for c in (cache, key, "__us")}
    ttl = round(ttl_s * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: object = run  # no cache has this name
        marks: dict[object, int] = {}  # in the order of marking
        for batch in batches:
            keep = []
            for c, k, us in zip(*(batch.column(place[x]).to_pylist() for x in (cache, key, "__us")), strict=True):
                if c != own:
                    own, marks = c, {}
                seen = k in marks and us - marks[k] <= ttl
                keep.append(not seen)
                if not seen:
                    if k in marks:
                        del marks[k]
                    elif len(marks) >= max_size:
                        del marks[next(iter(marks))]
                    marks[k] = us
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop("__us")


def batch_progress(jobs: DataFrame) -> DataFrame:
    """By batch: counts, done in percent (an empty batch is done) and whether it is finished."""
    kind = lambda k: F.count_if(F.col("outcome") == k)
    out = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), kind("completed").alias("completed"), kind("discarded").alias("discarded"))
    done = F.col("completed") + F.col("discarded")
    return out.withColumns({"percent": values.percent_done(done, F.col("total")), "finished": done == F.col("total")})


def acquire(requests: DataFrame, held: DataFrame, order: str) -> DataFrame:
    """Requests that get their lock: the first of each key that nobody holds."""
    return first_by(requests.join(held.select("lock_key"), "lock_key", "left_anti"), ["lock_key"], order)


def semaphore_grants(requests: DataFrame, max_value: int, order: str, held: DataFrame | None = None) -> DataFrame:
    """Requests with granted: the first of each key, as many as slots are free.

    held: key and value, the slots taken so far. Whether a slot has expired is not looked at here. ``order`` is a whole number that is a
    request's own.
    """
    placed = numbered(requests, "key", order, "__place")
    if held is None:
        return placed.withColumn("granted", F.col("__place") <= max_value).drop("__place")
    taken = held.select("key", F.col("value").alias("__taken"))
    return placed.join(taken, "key", "left").withColumn("granted", F.col("__place") + F.coalesce("__taken", F.lit(0)) <= max_value).drop("__place", "__taken")


def semaphores_after(held: DataFrame, granted: DataFrame, max_value: int) -> DataFrame:
    """Semaphores (key, value, max_value, expires_at) after granted requests (key, expires_at): values add up, the latest expiry holds, max_value is the new one."""
    new = granted.groupBy("key").agg(F.count("*").alias("__n"), F.max("expires_at").alias("__until"))
    both = held.join(new, "key", "full")
    return both.select(
        "key",
        (F.coalesce("value", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("long").alias("value"),
        F.when(F.col("__n").isNotNull(), F.lit(max_value)).otherwise(F.col("max_value")).cast("long").alias("max_value"),
        F.greatest("expires_at", "__until").alias("expires_at"),
    )


def semaphore_release(held: DataFrame, released: DataFrame) -> DataFrame:
    """Values after releases, never below 0."""
    gone = released.groupBy("key").agg(F.count("*").alias("n"))
    return held.join(gone, "key", "left").withColumn("value", F.greatest(F.col("value") - F.coalesce("n", F.lit(0)), F.lit(0).cast("long"))).drop("n")


def semaphores_expired(held: DataFrame, blocked: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expired keys, semaphores that stay, the blocked execution that each expired key lets go next)."""
    over = F.col("expires_at") < times.moment(as_of)
    gone = held.where(over).select("key")
    free = next_blocked(blocked.join(gone.withColumnRenamed("key", "concurrency_key"), "concurrency_key", "left_semi"), as_of)
    return gone, held.where(F.col("expires_at").isNull() | ~over), free


def uniqueness(requests: DataFrame, held: DataFrame, order: str, until: str = "executed", on_conflict: str = "reject") -> DataFrame:
    """requests (lock_key, ...) with outcome.

    until 'executed': the first request of a free key gets the lock as it is enqueued, others conflict. until 'executing': all are
    enqueued, the lock is taken when one starts, so none conflicts here. A conflict is 'rejected' (an error), 'discarded', or
    'logged' and discarded.
    """
    conflict = {"reject": "rejected", "discard": "discarded", "log": "logged"}[on_conflict]
    if until == "executing":
        return requests.withColumn("outcome", F.lit("enqueued"))
    if until != "executed":
        raise ValueError(f"{until!r} is neither 'executed' nor 'executing'")
    first = requests.groupBy("lock_key").agg(F.min(order).alias("__first"))
    taken = held.select("lock_key").distinct().withColumn("__held", F.lit(True))
    won = F.col("__held").isNull() & (F.col(order) == F.col("__first"))
    return requests.join(first, "lock_key").join(taken, "lock_key", "left").withColumn("outcome", F.when(won, "enqueued").otherwise(conflict)).drop("__first", "__held")


def next_blocked(blocked: DataFrame, as_of: str) -> DataFrame:
    """By concurrency key the execution to release: lowest priority number, then the oldest; expired ones are out."""
    alive = blocked.where(F.col("expires_at") > times.moment(as_of)).withColumn("rank", F.struct("priority", "created_at", "id"))
    return first_by(alive, ["concurrency_key"], "rank").drop("rank")


def conflict_outcome(granted: Column, policy: str) -> Column:
    return F.when(granted, "enqueue").otherwise({"block": "block", "discard": "discard", "raise": "raise"}[policy])


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """rows with streak: failures in a row up to here, 0 at a success. A hot key's rows are counted run by run."""
    dealt, n = runs.cut_in_runs(rows.withColumn("__failed", failed), order[0])
    by = Window.partitionBy(key, "__run").orderBy(*order)
    marked = dealt.withColumn("__island", F.count_if(~F.col("__failed")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "__run", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__own", F.when(F.col("__failed"), F.count_if(F.col("__failed")).over(inside)).otherwise(F.lit(0).cast("long")))
    if n > 1:  # the streak that a run begins with: that of the run before, and of those before it as far as they only failed
        each = marked.groupBy(key, "__run").agg(F.max_by("__own", F.struct(*order)).alias("__tail"), F.count_if(~F.col("__failed")).alias("__ok"))
        each = each.withColumn("__since", F.count_if(F.col("__ok") > 0).over(runs.over_runs(key)))
        total = F.sum("__tail").over(Window.partitionBy(key, "__since").orderBy("__run"))
        each = each.withColumn("__total", total).withColumn("__carry", F.coalesce(F.lag("__total").over(runs.over_runs(key)), F.lit(0)))
        marked = runs.joined(marked, each.select(key, "__run", "__carry"), key)
        marked = marked.withColumn("__own", F.when(F.col("__failed") & (F.col("__island") == 0), F.col("__own") + F.col("__carry")).otherwise(F.col("__own"))).drop("__carry")
    return marked.withColumnRenamed("__own", "streak").drop("__island", "__run", "__failed")


def breaker_trips(rows: DataFrame, key: str, order: list[str], failed: Column, after: int = 5, base: float = 30, most: float = 600) -> DataFrame:
    """Rows at which a key's breaker trips (every ``after`` failures in a row) with the trip's number and pause in seconds."""
    hit = streaks(rows, key, order, failed).where((F.col("streak") > 0) & (F.col("streak") % after == 0))
    trip = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return hit.withColumn("trip", trip.cast("long")).withColumn("pause_s", values.doubling(base, F.col("trip"), most))


def paused_at(trips: DataFrame, key: str, at: str, as_of: str) -> DataFrame:
    """By key whether its breaker holds it paused: until the pause of its last trip is over, when it goes on by itself. trips: as of breaker_trips, with a time."""
    last = trips.groupBy(key).agg(F.max_by(F.struct(at, "pause_s"), at).alias("t"))
    until = F.col(f"t.{at}") + F.make_dt_interval(secs=F.col("t.pause_s").cast("decimal(18,6)"))
    return last.select(key, (until > times.moment(as_of)).alias("paused"), until.alias("until"))


def restart_delays(rows: DataFrame, key: str, order: list[str], crashed: Column, base: float = 1, most: float = 60, uptime: Column | None = None, steady_s: float = 30) -> DataFrame:
    """Delay before each restart: doubling with the crash streak, none after a clean exit. A crash after steady_s of uptime starts a new streak."""
    if uptime is not None:
        steady = crashed & (uptime >= steady_s)
        marked = streaks(rows.withColumn("__steady", steady), key, order, crashed & ~steady)
        # the crash that starts anew is the first of its streak, and those after it come on top
        by = Window.partitionBy(key).orderBy(*order)
        island = F.count_if(F.col("__steady") | ~crashed).over(by.rowsBetween(Window.unboundedPreceding, 0))
        opened = marked.withColumn("__island", island)
        first = F.max(F.col("__steady")).over(Window.partitionBy(key, "__island"))
        streak = F.when(crashed, F.col("streak") + F.when(first, 1).otherwise(0)).otherwise(F.lit(0))
        out = opened.withColumn("streak", streak.cast("long")).drop("__steady", "__island")
        return out.withColumn("delay_s", F.when(F.col("streak") > 0, values.doubling(base, F.col("streak"), most)).otherwise(F.lit(0.0)))
    return streaks(rows, key, order, crashed).withColumn("delay_s", F.when(F.col("streak") > 0, values.doubling(base, F.col("streak"), most)).otherwise(F.lit(0.0)))


def maintenance_backoff(streak: Column, base: float = 30, most: float = 600) -> Column:
    return F.when(streak >= 2, values.doubling(base, streak - 1, most)).otherwise(F.lit(0.0))


def job_outcome(read_ct: Column, ok: Column, max_retries: int = 5, locked: Column | None = None) -> Column:
    """dead_lettered if read too often, skipped if another holds its lock while it runs, else success or failed."""
    spent = F.when(read_ct > max_retries, "dead_lettered")
    return (spent if locked is None else spent.when(locked, "skipped")).when(ok, "success").otherwise("failed")


def job_effects(outcome: Column) -> Column:
    """What happens to the message: archived, moved to the dead letters, or left until its visibility timeout is over."""
    return F.when(outcome == "success", "archive").when(outcome == "dead_lettered", "move").otherwise("leave")


def retained(rows: DataFrame, at: str, as_of: str, seconds: int) -> DataFrame:
    """Rows at or after the cutoff; rows without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= times.ago(as_of, seconds)))


def stream_retention(streams: DataFrame, rules: DataFrame, default_s: int = 300) -> DataFrame:
    """Seconds each stream is kept: by exact name, else by the first pattern that matches, else the default.

    rules: place, kind ('exact' or 'regex'), name, seconds; a small table whose size Spark checks.
    """
    own = streams.select("stream_name").distinct()
    exact = own.join(rules.where("kind = 'exact'").withColumnRenamed("name", "stream_name"), "stream_name").select("stream_name", "kind", "place", "seconds")
    regex = own.join(rules.where("kind = 'regex'"), F.regexp_like("stream_name", F.col("name"))).select("stream_name", "kind", "place", "seconds")
    hits = exact.unionByName(regex)
    best = hits.groupBy("stream_name").agg(F.min_by("seconds", F.struct(F.col("kind") != "exact", "place")).alias("seconds"))
    return streams.select("stream_name").distinct().join(best, "stream_name", "left").select("stream_name", F.coalesce("seconds", F.lit(default_s)).alias("keep_s"))


def orphan_streams(streams: DataFrame, as_of: str, threshold_s: int) -> DataFrame:
    """Streams to drop: empty, or whose newest message is at least that old; an unknown age is young."""
    age = times.seconds_between(times.moment(as_of), F.col("last_at"))
    return streams.where((F.col("n") == 0) | F.coalesce(age >= threshold_s, F.lit(False)))


def orphan_locks(locks: DataFrame, messages: DataFrame, as_of: str, vt_secs: int = 30) -> DataFrame:
    """Locks older than two visibility timeouts whose message is gone; a lock of an unknown queue is kept.

    A lock that was taken before its message had an id (msg_id 0 or below) goes by the key in the messages' bodies.
    """
    old = locks.where(F.col("created_at") < times.ago(as_of, 2 * vt_secs))
    known = old.join(messages.select("queue_name").distinct(), "queue_name", "left_semi")
    gone = known.where("msg_id > 0").join(messages.select("queue_name", "msg_id"), ["queue_name", "msg_id"], "left_anti")
    keys = messages.select("queue_name", lock_key_of(F.col("message")).alias("lock_key")).where("lock_key IS NOT NULL")
    return gone.unionByName(known.where("msg_id <= 0").join(keys, ["queue_name", "lock_key"], "left_anti").select(*gone.columns))


#: Fixed value: where a message's body holds its uniqueness key.
LOCK_KEY = "uniqueness_key"


def lock_key_of(body: Column) -> Column:
    return F.get_json_object(body, f"$.{LOCK_KEY}")


def key_exists(keys: DataFrame, messages: DataFrame) -> DataFrame:
    """keys (queue_name, lock_key) with exists: whether a message of the queue bears the key, null if the queue itself is unknown."""
    there = messages.select("queue_name", lock_key_of(F.col("message")).alias("lock_key")).distinct().withColumn("there", F.lit(True))
    queues = messages.select("queue_name", F.lit(True).alias("known")).distinct()
    out = keys.join(there, ["queue_name", "lock_key"], "left").join(queues, "queue_name", "left")
    return out.select("queue_name", "lock_key", F.when(F.col("known"), F.coalesce("there", F.lit(False))).alias("exists"))


def drained_split(backlog: DataFrame, drained: DataFrame | None) -> DataFrame:
    """Queues with drained: whether some process claims from them; None: all are claimed from."""
    if drained is None:
        return backlog.withColumn("drained", F.lit(True))
    marks = drained.select("queue_name", F.lit(True).alias("__d")).distinct()
    return backlog.join(marks, "queue_name", "left").withColumn("drained", F.coalesce("__d", F.lit(False))).drop("__d")


def fingerprints(queues: DataFrame, indexes: DataFrame) -> DataFrame:
    """Queues that bear a stream's mark in the index catalog, with the index. indexes: index_name."""
    named = queues.select("queue_name").distinct().withColumn("index_name", F.concat(F.lit("a_"), "queue_name", F.lit("_msg_id_idx")))
    return named.join(indexes.select("index_name").distinct(), "index_name", "left_semi").select("queue_name", "index_name")


def unregistered(queues: DataFrame, indexes: DataFrame, registry: DataFrame) -> DataFrame:
    """Queues that look like streams, by the index that only a stream's archive has, but are not registered. indexes: index_name."""
    return fingerprints(queues, indexes).join(registry, "queue_name", "left_anti").select("queue_name")



def zombies(messages: DataFrame, failures: DataFrame) -> DataFrame:
    """Messages read more than once without a recorded failure: the worker died or the job was dropped."""
    return messages.where("read_ct > 1").join(failures.select("queue_name", "msg_id"), ["queue_name", "msg_id"], "left_anti")


def message_exists(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """ids with exists: true, false, or null if the queue itself is unknown."""
    there = messages.select("queue_name", "msg_id", F.lit(True).alias("there")).distinct()
    queues = messages.select("queue_name", F.lit(True).alias("known")).distinct()
    out = ids.join(there, ["queue_name", "msg_id"], "left").join(queues, "queue_name", "left")
    return out.select("queue_name", "msg_id", F.when(F.col("known"), F.coalesce("there", F.lit(False))).alias("exists"))


def latest_failures(failures: DataFrame, most: int = 10_000, frames: int = 30) -> DataFrame:
    """The last error of each message, its text cut to a stored length and its backtrace, if there, to its first lines."""
    trace = ["backtrace"] if "backtrace" in failures.columns else []
    last = failures.groupBy("queue_name", "msg_id").agg(F.max_by(F.struct("error_class", "error_message", "failed_at", *trace), "failed_at").alias("e"))
    lines = [F.substring_index("e.backtrace", "\n", frames).alias(c) for c in trace]
    return last.select("queue_name", "msg_id", "e.error_class", F.substring("e.error_message", 1, most).alias("error_message"), "e.failed_at", *lines)


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows in place of old ones of the same key, old ones else."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def sync(tasks: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    """Recurring tasks after a sync: all of config, and the old ones that are not static."""
    return merge(tasks.where("NOT static"), config, keys)


def enqueue_kinds(jobs: DataFrame, special: Column, as_of: Column) -> DataFrame:
    """By queue how many jobs go one by one (special: they take locks or slots), in bulk at once, and in bulk with a delay."""
    later = F.col("vt") > as_of
    return jobs.groupBy("queue_name").agg(F.count_if(special).alias("special"), F.count_if(~special & ~later).alias("immediate"), F.count_if(~special & later).alias("scheduled"))


def locks_after(locks: DataFrame, gone: DataFrame) -> DataFrame:
    """Locks that stay when messages go: those whose key no gone body bears."""
    keys = gone.select(lock_key_of(F.col("message")).alias("lock_key")).where("lock_key IS NOT NULL").distinct()
    return locks.join(keys, "lock_key", "left_anti")


def handled(pending: DataFrame, as_of: str) -> DataFrame:
    """Rows of processed events (event_id, handler_class) that mark pending ones as done."""
    return pending.select("event_id", "handler_class", times.moment(as_of).alias("processed_at"))


def replayed(events: DataFrame) -> DataFrame:
    """events with target: the topic or, without a routing key, the handler they are published to again."""
    return events.withColumn("target", F.coalesce("routing_key", "handler_class"))


def bindable(new: DataFrame, queues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings that may be made, those refused with why: 'pattern' or 'queue'); the queue must exist."""
    known = queues.select("queue_name", F.lit(True).alias("__known")).distinct()
    marked = new.join(known, "queue_name", "left")
    why = F.when(~topics.valid_pattern(F.col("pattern")), "pattern").when(F.col("__known").isNull(), "queue")
    marked = marked.withColumn("refused", why).drop("__known")
    return marked.where("refused IS NULL").select(*new.columns), marked.where("refused IS NOT NULL")


def unbound(bindings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, queue_name and whether it existed of each binding to remove, bindings that stay)."""
    keys = ["pattern", "queue_name"]
    there = bindings.select(*keys).distinct().withColumn("__there", F.lit(True))
    told = gone.select(*keys).join(there, keys, "left").withColumn("existed", F.coalesce("__there", F.lit(False))).drop("__there")
    return told, bindings.join(gone.select(*keys), keys, "left_anti")


def bindings(rows: DataFrame, queue: str | None = None) -> DataFrame:
    """Bindings, of one queue if named, the newest first."""
    own = rows if queue is None else rows.where(F.col("queue_name") == queue)
    return own.orderBy(F.desc("bound_at"), "pattern", "queue_name")


def bound(bindings: DataFrame, new: DataFrame) -> DataFrame:
    """Bindings with new ones added unless they are there."""
    keys = ["pattern", "queue_name"]
    return bindings.unionByName(new.dropDuplicates(keys).join(bindings.select(*keys), keys, "left_anti"), allowMissingColumns=True)
