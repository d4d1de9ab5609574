"""Reads that change state, as pure functions: the rows a read claims, and the table after it.

Claiming sets vt to as_of + vt_secs, adds one to read_ct and notes last_read_at. A message is
claimable when its vt is not after as_of. FIFO groups without a key are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times

NO_GROUP = "_default_fifo_group"


def visible(as_of: str) -> Column:
    return F.col("vt") <= times.moment(as_of)


def claimed(rows: DataFrame, as_of: str | Column, vt_secs: int = 30) -> DataFrame:
    return rows.withColumns({"vt": times.ago(as_of, -vt_secs), "read_ct": F.col("read_ct") + 1, "last_read_at": times.moment(as_of)})


def read(messages: DataFrame, queue: str, as_of: str, qty: int = 1, condition: Column | None = None, vt_secs: int = 30) -> DataFrame:
    """The qty oldest claimable messages of a queue, claimed."""
    rows = messages.where((F.col("queue_name") == queue) & visible(as_of))
    rows = rows if condition is None else rows.where(condition)
    return claimed(rows.orderBy("msg_id").limit(qty), as_of, vt_secs)


def read_with_poll(messages: DataFrame, queue: str, as_of: str, qty: int = 1, condition: Column | None = None, vt_secs: int = 30, max_poll_s: float = 5, every_ms: int = 100) -> DataFrame:
    """read, tried again every every_ms until rows are claimable or max_poll_s have passed.

    In a table that nobody writes to, the try that finds rows follows from the least vt: one aggregate, no loop.
    """
    rows = messages.where(F.col("queue_name") == queue)
    rows = rows if condition is None else rows.where(condition)
    wait = F.greatest(times.seconds_between(F.min("vt"), times.moment(as_of)), F.lit(0.0))
    tick = F.ceil(F.round(wait * 1000 / every_ms, 6)) * every_ms / 1000  # the first try at or after the least vt
    found = rows.agg(tick.alias("after_s")).where(F.col("after_s") < max_poll_s)
    at = times.moment(as_of) + F.make_dt_interval(secs=F.col("after_s").cast("decimal(18,6)"))
    ready = rows.join(F.broadcast(found.select(at.alias("polled_at"))))  # one row
    ready = ready.where(F.col("vt") <= F.col("polled_at")).orderBy("msg_id").limit(qty)
    return ready.withColumns({"vt": F.col("polled_at") + F.make_dt_interval(secs=F.lit(vt_secs)), "read_ct": F.col("read_ct") + 1, "last_read_at": F.col("polled_at")})


def read_while_polling(messages: DataFrame, queue: str, as_of: str, condition: Column | None = None, vt_secs: int = 30, max_poll_s: float = 5, every_ms: int = 100) -> DataFrame:
    """All that read_with_poll hands over in max_poll_s, called again as soon as it returns; the next call after them starts with a try at their very end.

    A call after one that found rows tries at once, so qty holds no rows back: each message comes at the first try at or
    after its vt. It comes once, as it is worked off within vt_secs. One filter, whatever the number of tries.
    """
    after = lambda secs: times.moment(as_of) + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
    rows = messages.where((F.col("queue_name") == queue) & (F.col("vt") <= after(F.lit(max_poll_s))))
    rows = rows if condition is None else rows.where(condition)
    wait = F.greatest(times.micros(F.col("vt")) - times.micros(times.moment(as_of)), F.lit(0))
    tick = F.ceil(wait / (every_ms * 1000)) * every_ms / 1000  # the first try at or after vt
    return claimed(rows, after(F.least(tick, F.lit(float(max_poll_s)))), vt_secs)


def pop(messages: DataFrame, queue: str, as_of: str, qty: int = 1) -> tuple[DataFrame, DataFrame]:
    """(what is read, unclaimed, and removed; what stays)."""
    taken = messages.where((F.col("queue_name") == queue) & visible(as_of)).orderBy("msg_id").limit(qty)
    return taken, messages.join(taken.select("queue_name", "msg_id"), ["queue_name", "msg_id"], "left_anti")


def _group() -> Column:
    return F.coalesce("group_key", F.lit(NO_GROUP))


def fifo_heads(messages: DataFrame) -> DataFrame:
    """Each group's first message, whatever its visibility; one aggregate, no sort."""
    return messages.groupBy("queue_name", _group().alias("fifo_key")).agg(F.min("msg_id").alias("head_id"), F.min_by("vt", "msg_id").alias("head_vt"))


def _open_ranks(messages: DataFrame, queue: str, as_of: str, qty: int) -> DataFrame:
    """Claimable messages of groups whose head is claimable, with rank in group and head; qty a group at most."""
    own = messages.where(F.col("queue_name") == queue)
    heads = fifo_heads(own).where(F.col("head_vt") <= times.moment(as_of)).select("fifo_key", "head_id")
    rows = own.where(visible(as_of)).withColumn("fifo_key", _group()).join(heads, "fifo_key")
    rank = F.row_number().over(Window.partitionBy("fifo_key").orderBy("msg_id"))
    return rows.withColumn("msg_rank", rank).where(F.col("msg_rank") <= qty)


def read_grouped(messages: DataFrame, queue: str, as_of: str, qty: int, vt_secs: int = 30) -> DataFrame:
    """Groups in order of their heads, each drained before the next, as far as qty goes.

    A group whose head is not claimable yields nothing; of others all claimable messages come, later ones in flight or not.
    """
    return claimed(_open_ranks(messages, queue, as_of, qty).orderBy("head_id", "msg_rank").limit(qty), as_of, vt_secs)


def read_grouped_round_robin(messages: DataFrame, queue: str, as_of: str, qty: int, vt_secs: int = 30) -> DataFrame:
    """The first message of each group, then the second of each, and so on; within a layer by head."""
    return claimed(_open_ranks(messages, queue, as_of, qty).orderBy("msg_rank", "head_id").limit(qty), as_of, vt_secs)


def read_grouped_heads(messages: DataFrame, queue: str, as_of: str, qty: int, vt_secs: int = 30) -> DataFrame:
    """At most one message a group: its head, if claimable."""
    own = messages.where(F.col("queue_name") == queue)
    heads = fifo_heads(own).where(F.col("head_vt") <= times.moment(as_of)).select(F.col("head_id").alias("msg_id"))
    return claimed(own.join(heads, "msg_id").orderBy("msg_id").limit(qty), as_of, vt_secs)


GROUPED = {"fill": read_grouped, "round_robin": read_grouped_round_robin, "heads": read_grouped_heads}


def read_grouped_with_poll(messages: DataFrame, queue: str, as_of: str, qty: int, order: str = "fill", vt_secs: int = 30, max_poll_s: float = 5, every_ms: int = 100) -> DataFrame:
    """A grouped read, tried again every every_ms until some group's head is claimable or max_poll_s have passed.

    The try that finds rows follows from the least vt of the heads: one value comes to the driver.
    """
    heads = fifo_heads(messages.where(F.col("queue_name") == queue))
    wait = F.greatest(times.seconds_between(F.min("head_vt"), times.moment(as_of)), F.lit(0.0))
    tick = F.ceil(F.round(wait * 1000 / every_ms, 6)) * every_ms / 1000
    polled = times.moment(as_of) + F.make_dt_interval(secs=F.col("after_s").cast("decimal(18,6)"))
    row = heads.agg(tick.alias("after_s")).where(F.col("after_s") < max_poll_s).select(polled.cast("string").alias("at")).first()
    return GROUPED[order](messages, queue, row.at if row else as_of, qty if row else 0, vt_secs)


def read_prioritized(messages: DataFrame, as_of: str, qty: int, priority: Column, vt_secs: int = 30) -> DataFrame:
    """Priority 0 is drained first, then 1 and so on."""
    return claimed(messages.where(visible(as_of)).withColumn("priority", priority).orderBy("priority", "msg_id").limit(qty), as_of, vt_secs)


def read_multi(messages: DataFrame, queues: list[str], as_of: str, qty: int, limit: int, vt_secs: int = 30) -> DataFrame:
    """At most qty from each queue and limit in all; queues named earlier come first."""
    place = F.array_position(F.array(*map(F.lit, queues)), F.col("queue_name"))
    rows = messages.where(F.col("queue_name").isin(queues) & visible(as_of))
    rank = F.row_number().over(Window.partitionBy("queue_name").orderBy("msg_id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= qty).withColumn("place", place)
    return claimed(rows.orderBy("place", "msg_id").limit(limit).drop("rank", "place"), as_of, vt_secs)


def archive(messages: DataFrame, ids: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(archived rows, rows that stay); ids: queue_name, msg_id."""
    keys = ["queue_name", "msg_id"]
    return messages.join(ids, keys, "left_semi").withColumn("archived_at", times.moment(as_of)), messages.join(ids, keys, "left_anti")


def delete(messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that were there, rows that stay)."""
    keys = ["queue_name", "msg_id"]
    return messages.select(*keys).join(ids, keys, "left_semi"), messages.join(ids, keys, "left_anti")


def set_vt(messages: DataFrame, ids: DataFrame, vt: Column) -> DataFrame:
    """The named rows with their new vt; everything else as it was."""
    marked = ids.select("queue_name", "msg_id", F.lit(True).alias("__hit"))
    return messages.join(marked, ["queue_name", "msg_id"], "left").withColumn("vt", F.when(F.col("__hit"), vt).otherwise(F.col("vt"))).drop("__hit")


RUN = 1_000_000


def numbered(rows: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """rows with their place, from 1, among those of the same ``by`` in the order of a whole number that is theirs alone.

    Runs of RUN numbers are counted first and ranked apart, so a key with most of the rows is many tasks' work.
    """
    run = rows.withColumn("__run", F.floor(F.col(order) / RUN))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = run.groupBy(by, "__run").agg(F.count("*").alias("__n")).select(by, "__run", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__run").orderBy(order))
    return run.withColumn("__inside", inside).join(runs, [by, "__run"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__run", "__inside", "__before")


def high_water(messages: DataFrame, *others: DataFrame) -> DataFrame:
    """(queue_name, last_id): the largest id that each queue has given out, by live rows and others (archives, marks of ids), which deletes don't lower."""
    ids = messages.select("queue_name", "msg_id")
    for rows in others:
        ids = ids.unionByName(rows.select("queue_name", "msg_id"))
    return ids.groupBy("queue_name").agg(F.max("msg_id").alias("last_id"))


def produced(rows: DataFrame, marks: DataFrame, as_of: str) -> DataFrame:
    """rows as new messages of the queue_name they bear: ids beyond its last one in the order of the old ids, unread, visible at once."""
    last = marks.select("queue_name", "last_id")
    new = numbered(rows, "queue_name", "msg_id", "__new").join(last, "queue_name", "left")
    now = times.moment(as_of)
    fresh = {"msg_id": F.coalesce("last_id", F.lit(0)) + F.col("__new"), "read_ct": F.lit(0), "enqueued_at": now, "vt": now}
    return new.withColumns(fresh).select(*rows.columns)


def dead_letter(messages: DataFrame, as_of: str, max_retries: int = 5, suffix: str = "_dlq", marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new messages of the dead-letter queues, rows that stay): rows read more than max_retries times move, bodies and headers as they are.

    marks: high_water() of all queues; without it, of the rows at hand. Old ids must be unique in each queue.
    """
    spent = (F.col("read_ct") > max_retries) & ~F.col("queue_name").endswith(suffix)
    moved = messages.where(spent).withColumn("queue_name", F.concat("queue_name", F.lit(suffix)))
    return produced(moved, high_water(messages) if marks is None else marks, as_of), messages.where(~spent)


def reroute(messages: DataFrame, source: str, target: str, as_of: str, body: Column | None = None, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a queue's messages as new ones of another queue, with their bodies or another; rows that stay)."""
    rows = messages.where(F.col("queue_name") == source)
    rows = rows.withColumns({"queue_name": F.lit(target), "message": F.col("message") if body is None else body})
    return produced(rows, high_water(messages) if marks is None else marks, as_of), messages.where(F.col("queue_name") != source)


def retry_dead_letters(messages: DataFrame, as_of: str, suffix: str = "_dlq", marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all dead letters as new messages of the queues they came from, rows that stay)."""
    dead = F.col("queue_name").endswith(suffix)
    rows = messages.where(dead).withColumn("queue_name", F.expr(f"left(queue_name, length(queue_name) - {len(suffix)})"))
    return produced(rows, high_water(messages) if marks is None else marks, as_of), messages.where(~dead)
