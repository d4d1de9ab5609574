"""Streaming queries: watermarked windows, idempotent consumption, throttled notifications, completion events.

Windows, watermarks and late data are extensions: the batch operators know none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming import fanout


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", width: str = "1 minute", *by: str) -> DataFrame:
    """Counts by window; rows later than the watermark are dropped, windows come out when they close."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), *by).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], at: str, horizon: str = "7 days") -> DataFrame:
    """Each key once within the horizon: the state of older keys goes with the watermark."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def throttled(events: DataFrame, key: str, at: str, interval_ms: int) -> DataFrame:
    """At most one row a key and interval since the last one that went out; state is one time a key."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for batch in batches for t in batch[at]):
            now = int(t.value // 1000)
            if last is None or now - last >= interval_ms * 1000:
                last = now
                out.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(out), at: out})

    kind = dict(events.dtypes)
    return events.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {at} {kind[at]}", "last long", "append", GroupStateTimeout.NoTimeout)


def completions(jobs: DataFrame) -> DataFrame:
    """(batch_id, done) once for each batch, when its last job ends. jobs: batch_id, total, outcome."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, fired = state.get if state.exists else (0, False)
        total = None
        for batch in batches:
            done += int(batch["outcome"].isin(["completed", "discarded"]).sum())
            total = int(batch["total"].max())
        ready = total is not None and done >= total and not fired
        state.update((done, fired or ready))
        yield pd.DataFrame({"batch_id": [name[0]] * ready, "done": [done] * ready})

    return jobs.groupBy("batch_id").applyInPandasWithState(step, "batch_id long, done long", "done long, fired boolean", "append", GroupStateTimeout.NoTimeout)


def throttled_batch(events: DataFrame, key: str, at: str, interval_ms: int) -> DataFrame:
    """throttled over a finished log: the times that open a window of the interval; a hot key's log is gone through in runs, apart."""
    marked = fanout.windows(events.select(key, at), [key], at, interval_ms / 1000)
    return marked.groupBy(key, "window").agg(F.min(at).alias(at)).select(key, at)


def polled(messages: DataFrame, sink, path: str, every: str = "100 milliseconds"):
    """A consumer loop: each trigger hands what is new in a stream of messages to sink(rows, batch number), with progress kept under path."""
    return messages.writeStream.foreachBatch(sink).trigger(processingTime=every).option("checkpointLocation", path).start()
