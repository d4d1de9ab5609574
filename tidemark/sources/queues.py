"""Message tables: pages, logs over live and archived rows, appends, and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names, times, topics
from tidemark.operators import claims

MESSAGE = ("msg_id", "queue_name", "read_ct", "enqueued_at", "last_read_at", "vt", "message", "headers")
#: The header that names a message's FIFO group, unless a log has another name for it.
GROUP_HEADER = "x-fifo-group"


def page(messages: DataFrame, limit: int, offset: int = 0, queues: list[str] | None = None, key: str = "msg_id") -> DataFrame:
    """Newest first. Queues are a partition filter, so other queues aren't read."""
    rows = messages if queues is None else messages.where(F.col("queue_name").isin(queues))
    return rows.orderBy(F.desc(key)).offset(offset).limit(limit)


def message(messages: DataFrame, queue: str, msg_id: int) -> DataFrame:
    return messages.where((F.col("queue_name") == queue) & (F.col("msg_id") == msg_id))


def total_pages(rows: DataFrame, per_page: int) -> DataFrame:
    return rows.agg(F.ceil(F.count("*") / per_page).cast("long").alias("pages"))


def log(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live and archived rows as one, each with its source; rows that are on both sides stay twice."""
    return live.withColumn("source", F.lit("live")).unionByName(archive.withColumn("source", F.lit("archive")), allowMissingColumns=True)


def read_after(live: DataFrame, archive: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    """The next messages after a cursor. Each side is cut to the limit before they meet."""
    side = lambda rows: rows.where(F.col("msg_id") > cursor).orderBy("msg_id").limit(limit)
    return log(side(live), side(archive)).orderBy("msg_id").limit(limit)


def message_bounds(live: DataFrame, archive: DataFrame, by: list[str]) -> DataFrame:
    """By group: current_id (largest live id, 0 if none) and oldest_id (smallest of either side)."""
    both = log(live, archive)
    live_id = F.when(F.col("source") == "live", F.col("msg_id"))
    return both.groupBy(*by).agg(F.coalesce(F.max(live_id), F.lit(0).cast("long")).alias("current_id"), F.min("msg_id").alias("oldest_id"))


def prepared(messages: DataFrame, payload: list[str], levels: int = 1) -> DataFrame:
    """Messages (queue_name, priority and payload columns) as a client sends them: queue_name with the sub-queue of the priority, if there are levels, and message as JSON."""
    target = names.with_priority(F.col("queue_name"), F.coalesce("priority", F.lit(0)), levels) if levels > 1 else F.col("queue_name")
    body = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return messages.select(target.alias("queue_name"), body.alias("message"))


def checked_batch(messages: list[str], headers: list[str | None] | None) -> list[tuple[str, str | None]]:
    """Pairs for send_batch; a batch must hold messages, and headers, if any, must be as many."""
    if not messages:
        raise ValueError("a batch needs at least one message")
    if headers is not None and len(headers) != len(messages):
        raise ValueError(f"{len(messages)} messages but {len(headers)} headers")
    return list(zip(messages, headers or [None] * len(messages), strict=True))


def records(messages: DataFrame) -> DataFrame:
    """The eight fields of a message, in their order; those that the table lacks are null."""
    kinds = {"read_ct": "int", "last_read_at": "timestamp_ntz", "headers": "string"}
    return messages.select(*[F.col(c) if c in messages.columns else F.lit(None).cast(kinds[c]).alias(c) for c in MESSAGE])


def group_of(headers: Column, header: str = GROUP_HEADER) -> Column:
    """The FIFO group that a message's headers name, null if none."""
    return F.get_json_object(headers, f"$['{header}']")


def sent(messages: DataFrame, bodies: DataFrame, as_of: str, delay: int | Column = 0, marks: DataFrame | None = None) -> DataFrame:
    """The new rows of bodies (queue_name, position, message and maybe headers): ids go on from each queue's last one, vt is delay seconds on.

    marks: queue_name and last_id, the largest id each queue ever gave out, which popped and archived rows don't lower; without it the rows at hand tell.
    """
    last = marks if marks is not None else messages.groupBy("queue_name").agg(F.max("msg_id").alias("last_id"))
    return bodies.join(last.select("queue_name", "last_id"), "queue_name", "left").select(
        (F.coalesce("last_id", F.lit(0)) + F.col("position")).cast("long").alias("msg_id"),
        "queue_name",
        F.lit(0).alias("read_ct"),
        times.moment(as_of).alias("enqueued_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_read_at"),
        times.ago(as_of, -delay).alias("vt"),
        "message",
        F.col("headers") if "headers" in bodies.columns else F.lit(None).cast("string").alias("headers"),
    )


def send(messages: DataFrame, bodies: DataFrame, as_of: str, delay: int | Column = 0, marks: DataFrame | None = None) -> DataFrame:
    """messages with the rows of sent() appended."""
    return records(messages).unionByName(sent(messages, bodies, as_of, delay, marks))


def routed(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row for each message and queue that some binding of the key leads to.

    Messages are matched by distinct key, so a regex is tried once for each key and pattern,
    whatever the number of messages; then keys join back by equality.
    """
    keys = messages.select("routing_key").distinct().where(topics.valid_routing_key(F.col("routing_key")))
    hits = keys.join(bindings.select("queue_name", "compiled_regex"), F.regexp_like("routing_key", F.col("compiled_regex")))
    return messages.join(hits.select("routing_key", F.col("queue_name").alias("target")).distinct(), "routing_key")


def send_topic(messages: DataFrame, bodies: DataFrame, bindings: DataFrame, as_of: str, delay: int | Column = 0, marks: DataFrame | None = None) -> DataFrame:
    """The new rows of bodies (position, routing_key, message and maybe headers), one for each queue that their key leads to, in the order of position."""
    targets = routed(bodies, bindings).withColumnRenamed("target", "queue_name")
    return sent(messages, claims.numbered(targets.withColumnRenamed("position", "__at"), "queue_name", "__at", "position").drop("__at"), as_of, delay, marks)


def handlers_for(keys: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(routing_key, handler_class, queue_name) of every subscriber whose pattern matches a key."""
    return keys.join(subscribers, topics.matches(F.col("routing_key"), F.col("compiled_regex"))).select("routing_key", "handler_class", "queue_name")


def queues_for_topics(topic_filters: list[str], subscribers: DataFrame) -> DataFrame:
    """The queues that a consumer of these topic filters reads: of every subscriber that one of them may lead to."""
    hit = F.lit(False)
    for one in topic_filters:
        hit = hit | topics.overlaps(F.lit(one), F.col("pattern"))
    return subscribers.where(hit).select("queue_name").distinct()


def test_routing(keys: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every binding that a key matches, with its pattern."""
    return keys.join(bindings, topics.matches(F.col("routing_key"), F.col("compiled_regex"))).select("routing_key", "pattern", "queue_name", "compiled_regex")


def unpublished(outbox: DataFrame, limit: int = 100) -> DataFrame:
    return outbox.where("published_at IS NULL").orderBy("id").limit(limit)


def outbox_groups(outbox: DataFrame) -> DataFrame:
    """How waiting entries are sent together: topics one by one, queue entries by queue and priority."""
    waiting = outbox.where("published_at IS NULL")
    route = F.when(F.col("routing_key").isNotNull(), "topic").otherwise("queue")
    target = F.coalesce("routing_key", "queue_name")
    return waiting.groupBy(route.alias("route"), target.alias("target"), "priority", "delay").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def outbox_stats(outbox: DataFrame, as_of: str) -> DataFrame:
    """unpublished, total and the age of the oldest waiting entry: the one with the lowest id, not the earliest time."""
    waiting = F.col("published_at").isNull()
    oldest = F.min_by(F.when(waiting, F.col("created_at")), F.when(waiting, F.col("id")))
    return outbox.agg(F.count_if(waiting).alias("unpublished"), F.count("*").alias("total"), times.age_seconds(as_of, oldest).alias("oldest_age_s"))


def one_target(outbox: DataFrame) -> DataFrame:
    """Entries that name a queue or a routing key, but not both."""
    return outbox.where(F.col("queue_name").isNull() != F.col("routing_key").isNull())


def partition_key(messages: DataFrame, interval: str, at: str = "enqueued_at") -> DataFrame:
    """The partition of each row: ids in runs if the interval is a number, else days of a time (archives: archived_at)."""
    if interval.isdigit():
        return messages.withColumn("partition", F.floor(F.col("msg_id") / int(interval)).cast("string"))
    return messages.withColumn("partition", F.date_format(F.date_trunc("day", at), "yyyy-MM-dd"))


def write_partitioned(messages: DataFrame, path: str, interval: str, at: str = "enqueued_at") -> None:
    """The messages as a table of one folder for each partition of partition_key, so a filter on partition reads no others."""
    partition_key(messages, interval, at).repartition("partition").write.mode("overwrite").partitionBy("partition").parquet(path)


def detached(catalog: DataFrame, queue: str) -> tuple[DataFrame, DataFrame]:
    """(the archives that leave the catalog's care, the catalog without them): their rows stay where they are."""
    own = F.col("queue_name") == queue
    return catalog.where(own).select("queue_name", F.concat(F.lit("a_"), "queue_name").alias("table_name")), catalog.where(~own)


def split_kinds(catalog: DataFrame, streams: DataFrame, events: DataFrame) -> DataFrame:
    """Queues with kind: dead_letter, stream, event or job."""
    mark = lambda rows, name: rows.select("queue_name", F.lit(True).alias(name)).distinct()
    out = catalog.join(mark(streams, "__s"), "queue_name", "left").join(mark(events, "__e"), "queue_name", "left")
    kind = F.when(names.is_dead_letters(F.col("queue_name")), "dead_letter").when(F.col("__s"), "stream").when(F.col("__e"), "event").otherwise("job")
    return out.withColumn("kind", kind).drop("__s", "__e")


def purge(messages: DataFrame, queue: str) -> tuple[DataFrame, DataFrame]:
    """(count of what goes, what stays)."""
    gone = F.col("queue_name") == queue
    return messages.where(gone).agg(F.count("*").alias("purged")), messages.where(~gone)
