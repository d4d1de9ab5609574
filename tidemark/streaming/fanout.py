"""Streams of messages to clients: cursors, coalescing, backpressure, presence, throttling.

Batch forms take a log and give what a stream would have emitted by its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import runs


def min_cursors(clients: DataFrame) -> DataFrame:
    """By stream the place to read from: the smallest of each client's further cursor, 0 without any."""
    return clients.groupBy("stream_name").agg(F.coalesce(F.min(F.greatest("scanned", "sent")), F.lit(0)).cast("long").alias("cursor"))


def deliveries(log: DataFrame, clients: DataFrame, visible: Column | None = None) -> DataFrame:
    """(client, stream_name, msg_id) each client is still to get: beyond its cursor, and visible to it."""
    ahead = F.col("msg_id") > F.greatest("scanned", "sent")
    rows = log.join(clients, "stream_name").where(ahead)
    return (rows if visible is None else rows.where(visible)).select("client", "stream_name", "msg_id")


def replay_then_live(replay: DataFrame, live: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """A replay followed by buffered live messages, each message once for each client; clients (client, stream_name, sent): nothing up to the last sent id."""
    both = replay.unionByName(live).dropDuplicates(["client", "stream_name", "msg_id"])
    if clients is None:
        return both
    last = clients.select("client", "stream_name", F.col("sent").alias("__sent"))
    return both.join(last, ["client", "stream_name"], "left").where(F.col("msg_id") > F.coalesce("__sent", F.lit(0))).drop("__sent")


def acknowledged(written: DataFrame) -> DataFrame:
    """By client the cursor after a batch: the largest written id; its end if all was filtered; none if the connection died."""
    done = F.when(~F.col("alive"), F.lit(None)).when(F.col("kept") == 0, F.col("batch_max")).otherwise(F.col("written_max"))
    return written.select("client", F.coalesce(done, F.col("last_sent")).alias("cursor"))


#: Rows of a key that a task goes through in one run of time, about.
RUN_ROWS = 1_000_000


def _exits(group: pa.Table, window_us: int) -> pa.Table:
    """Of one key's times in a run: by the time from which a window may open (upto, the last such time), when the window that is then open at the run's end closes."""
    times_ = np.sort(np.asarray(group.column("__us").to_numpy(), np.int64))
    after = np.searchsorted(times_, times_ + window_us)  # the next row that opens a window
    close = times_ + window_us
    for i in range(len(times_) - 1, -1, -1):
        if after[i] < len(times_):
            close[i] = close[after[i]]
    last = np.flatnonzero(np.append(close[1:] != close[:-1], True))  # entries of one outcome are one row
    out = group.take(pa.array(np.zeros(len(last), np.int64)))
    return pa.table({**{c: out.column(c) for c in out.column_names if c != "__us"}, "upto": pa.array(times_[last]), "close": pa.array(close[last])})


def windows(rows: DataFrame, keys: list[str], at: str, window_s: float, run_rows: int = RUN_ROWS) -> DataFrame:
    """rows with window (microseconds): the start of the window each is in. A key's first row opens a window, and so does each first row window_s or more after the last opening.

    A key's log is cut into runs of time. Each run tells, for every time from which a window may open in it, when the window open at its
    end closes; chains of windows soon meet, so that is a short table. One pass over these tables, key by key, gives what is open as
    each run begins, and then runs go through their rows apart. So a key with most of the rows is many tasks' work.
    """
    width = int(window_s * 1e6)
    dealt = rows.withColumn("__us", times.micros(F.col(at)))
    low, high, n = dealt.agg(F.min("__us"), F.max("__us"), F.count("*")).first()
    if not n:
        return dealt.withColumn("window", F.col("__us")).drop("__us")
    run = max(width, -(-(high - low + 1) // -(-n // run_rows)), 1)
    dealt = dealt.withColumn("__run", F.floor((F.col("__us") - low) / run))
    kinds = dict(dealt.dtypes)
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    exits = dealt.select(*keys, "__run", "__us").distinct().groupBy(*keys, "__run").applyInArrow(lambda group: _exits(group, width), f"{typed}, __run long, upto long, close long")
    tables = exits.repartition(*keys).sortWithinPartitions(*keys, "__run", "upto")
    n_keys = len(keys)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, open_until, known = None, None, 0, False
        for batch in batches:
            out = []
            for *own, r, upto, close in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, now, open_until = own, None, -(1 << 62)
                if r != now:
                    now, known = r, False
                    out.append((*own, r, open_until))
                if not known and upto >= open_until:
                    open_until, known = close, True
            columns = list(zip(*out, strict=True)) or [[]] * (n_keys + 2)
            types = [*[batch.schema.field(i).type for i in range(n_keys)], pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*[f"__k{i}" for i in range(n_keys)], "__r", "__open"])

    begun = tables.mapInArrow(entries, ", ".join(f"__k{i} {kinds[k]}" for i, k in enumerate(keys)) + ", __r long, __open long")
    same = F.col("__run") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    whole = dealt.join(begun, same).select(*dealt.columns, "__open")
    whole = whole.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", "__us")
    place = [whole.columns.index(c) for c in (*keys, "__run", "__us", "__open")]

    def run_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = None, 0
        for batch in batches:
            out = []
            for *own, us, begin in zip(*(batch.column(i).to_pylist() for i in place), strict=True):
                if own != last:
                    last, until = own, begin
                if us >= until:
                    until = us + width
                out.append(until - width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "window"])

    return whole.mapInArrow(run_through, whole.withColumn("window", F.lit(0).cast("long")).schema).drop("__us", "__run", "__open")


def coalesced(frames: DataFrame, keys: list[str], at: str, order: str, window_s: float) -> DataFrame:
    """The last frame of each key (stream and target) in windows that their first frame opens, with flushed_at, the window's end."""
    marked = windows(frames, keys, at, window_s)
    rest = [c for c in frames.columns if c not in keys]
    best = marked.groupBy(*keys, "window").agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("f"))
    flushed = F.timestamp_micros((F.col("window") + int(window_s * 1e6))).cast("timestamp_ntz")
    return best.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest], flushed.alias("flushed_at"))


def visible_to(label: Column, predicates: dict[str, Column]) -> Column:
    """Whether a broadcast is for a client: without a label for all; else if its predicate holds. Unknown labels, and predicates that give null, hide it."""
    out = F.lit(False)
    for name, holds in predicates.items():
        out = F.when(label == name, F.coalesce(holds, F.lit(False))).otherwise(out)
    return F.when(label.isNull(), True).otherwise(out)


#: Fixed value: bytes that a notification's payload has at most.
NOTIFY_BYTES = 7999


def notify_route(payload: Column, most: int = NOTIFY_BYTES) -> Column:
    """How a frame goes out: in the notification itself, or stored if it is too large for one."""
    return F.when(F.octet_length(payload) > most, "durable").otherwise("notify")


def beats(connections: DataFrame, as_of: str, beat_s: float = 15, idle_s: float = 3600) -> DataFrame:
    """Connections with what their heartbeat does now: close what nobody used for idle_s, write to what was silent for beat_s, else nothing. last_used_at, last_write_at."""
    used, wrote = (times.seconds_between(times.moment(as_of), F.col(c)) for c in ("last_used_at", "last_write_at"))
    return connections.withColumn("action", F.when(used >= idle_s, "close").when(wrote >= beat_s, "beat").otherwise("none"))


def deferred(broadcasts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Broadcasts as they go out: those of a transaction at its commit, never if it rolled back, others at once.

    broadcasts: at and tx_id (null: none); transactions: tx_id, committed_at (null: rolled back).
    """
    known = transactions.select("tx_id", "committed_at", F.lit(True).alias("__known"))
    out = broadcasts.join(known, "tx_id", "left").where(F.col("tx_id").isNull() | F.col("committed_at").isNotNull())
    return out.withColumn("sent_at", F.coalesce("committed_at", "at")).drop("committed_at", "__known")


def ephemeral(broadcasts: DataFrame, clients: DataFrame, visible: Column | None = None) -> DataFrame:
    """(client, stream_name, msg_id) of broadcasts without storage (stream_name, seq): negative ids, to every client of the stream, whatever its cursor."""
    rows = broadcasts.join(clients.select("client", "stream_name"), "stream_name").withColumn("msg_id", -1 - F.col("seq"))
    return (rows if visible is None else rows.where(visible)).select("client", "stream_name", "msg_id")


def members_after(members: DataFrame, joins: DataFrame, as_of: str) -> DataFrame:
    """Members after joins (stream_name, member_id, metadata): a known one gets the new metadata and is seen now, and keeps joined_at."""
    keys = ["stream_name", "member_id"]
    new = joins.groupBy(*keys).agg(F.max("metadata").alias("__new")).withColumn("__hit", F.lit(True))
    both = members.join(new, keys, "full")
    now = times.moment(as_of)
    return both.select(*keys, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("metadata")).alias("metadata"), F.coalesce("joined_at", now).alias("joined_at"), F.when(F.col("__hit"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def members_left(members: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that were there and left, members that stay)."""
    keys = ["stream_name", "member_id"]
    return members.join(leaves.select(*keys), keys, "left_semi"), members.join(leaves.select(*keys), keys, "left_anti")


def members_touched(members: DataFrame, touches: DataFrame, as_of: str) -> DataFrame:
    """Members with last_seen_at now for those who were heard of; nobody joins by that."""
    keys = ["stream_name", "member_id"]
    hits = touches.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return members.join(hits, keys, "left").withColumn("last_seen_at", F.when(F.col("__hit"), times.moment(as_of)).otherwise(F.col("last_seen_at"))).drop("__hit")


def members_swept(members: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(members last seen before the cutoff, members that stay)."""
    old = F.col("last_seen_at") < times.moment(cutoff)
    return members.where(old), members.where(~old)


def newest_within(jobs: DataFrame, client: str, order: str, frames: str, cap: int) -> DataFrame:
    """Drop-oldest: the newest write jobs of a client whose frames fit the cap; the newest passes however large it is.

    A hot client's jobs are summed up run by run, and only runs that the cap reaches are looked into.
    """
    dealt, n = runs.cut_in_runs(jobs, order)
    newer = F.lit(0).cast("long")
    if n > 1:
        later = Window.partitionBy(client).orderBy(F.desc("__run")).rowsBetween(Window.unboundedPreceding, -1)
        each = dealt.groupBy(client, "__run").agg(F.sum(frames).alias("__frames")).withColumn("__newer", F.coalesce(F.sum("__frames").over(later), F.lit(0)))
        each = each.withColumn("__last", F.max("__run").over(Window.partitionBy(client)) == F.col("__run"))
        dealt = runs.joined(dealt, each.where((F.col("__newer") <= cap) | F.col("__last")).select(client, "__run", "__newer", "__last"), client)
        newer = F.col("__newer")
    by = Window.partitionBy(client, "__run").orderBy(F.desc(order))
    marked = dealt.withColumns({"__sum": F.sum(frames).over(by.rowsBetween(Window.unboundedPreceding, 0)) + newer, "__rank": F.row_number().over(by)})
    newest = (F.col("__rank") == 1) & (F.col("__last") if n > 1 else F.lit(True))
    return marked.where((F.col("__sum") <= cap) | newest).drop("__sum", "__rank", "__run", "__newer", "__last")


def presence(events: DataFrame, as_of: str, timeout_s: int, left: Column) -> DataFrame:
    """Members by stream: last event no departure, and seen within the timeout."""
    last = events.groupBy("stream_name", "member_id").agg(F.max("seen_at").alias("seen_at"), F.max_by(left, F.struct("seen_at", "event_id")).alias("gone"))
    return last.where(~F.col("gone") & (F.col("seen_at") >= times.ago(as_of, timeout_s))).drop("gone")


def writer_of(client_hash: Column, writers: int) -> Column:
    """The writer that all frames of a client go to, by the client's hash."""
    return F.pmod(client_hash, F.lit(writers))


def wakes(notifications: DataFrame, batch: Column) -> DataFrame:
    """One wake a queue and batch."""
    return notifications.select("queue_name", batch.alias("batch")).distinct()


def sessions(events: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """Connections by idle timeout: runs of events less than the gap apart. A hot key's events are numbered stretch by stretch."""
    dealt, n = runs.cut_in_runs(events, at)
    by = Window.partitionBy(key, "__run").orderBy(at)
    before = F.lag(at).over(by)
    if n > 1:
        ends = dealt.groupBy(key, "__run").agg(F.max(at).alias("__end")).withColumn("__before", F.lag("__end").over(runs.over_runs(key)))
        dealt = runs.joined(dealt, ends.select(key, "__run", "__before"), key)
        before = F.coalesce(before, F.col("__before"))
    new = F.coalesce(times.seconds_between(F.col(at), before) >= gap_s, F.lit(True))
    marked = dealt.withColumn("__new", new)
    marked = marked.withColumn("session", F.count_if(F.col("__new")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    if n > 1:
        count = marked.groupBy(key, "__run").agg(F.count_if(F.col("__new")).alias("__n"))
        ahead = F.coalesce(F.sum("__n").over(runs.over_runs(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        marked = runs.joined(marked, count.select(key, "__run", ahead.alias("__ahead")), key).withColumn("session", F.col("session") + F.col("__ahead"))
    return marked.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
