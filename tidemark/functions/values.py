"""Small scalar rules: backoff, percentages, ids, labels, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubling(base: float, n: Column, most: float) -> Column:
    """base * 2^(n-1), at most ``most``, for n of 1 or more."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), n - 1), F.lit(float(most)))


def retry_delay(read_ct: Column, base: float = 5, most: float = 300, jitter: float = 0.0, chance: Column | None = None) -> Column:
    """Seconds to wait after a failed read; the first read's failure is attempt 0 and waits none.

    jitter: by how large a share the wait may be longer or shorter, as chance (0 to 1, such as a hash of the message) says; the most holds after it too.
    """
    attempt = read_ct - 1
    wait = doubling(base, attempt, most)
    if jitter:
        share = 1 + jitter * (2 * (F.lit(0.5) if chance is None else chance) - 1)
        wait = F.least(wait * share, F.lit(float(most)))
    return F.when(attempt >= 1, wait).otherwise(F.lit(0.0))


def wrapped(payload: Column) -> Column:
    """A payload as an event's: JSON objects and arrays as they are, scalars and other text under the key value."""
    kind = F.schema_of_variant(F.try_parse_json(payload))
    whole = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    scalar = F.when(kind.isNull(), F.to_json(F.struct(payload.alias("value")))).otherwise(F.concat(F.lit('{"value":'), payload, F.lit("}")))
    return F.when(whole, payload).otherwise(scalar)


def unwrapped(envelope: Column, key: str = "html") -> Column:
    """What a stream's envelope holds under key; a text that is no envelope passes as it is."""
    inner = F.get_json_object(envelope, f"$.{key}")
    return F.coalesce(inner, envelope)


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(100).cast("long")


def ratio(part: Column, total: Column, places: int = 4) -> Column:
    return F.when(total > 0, F.round(part / total, places)).otherwise(F.lit(0.0))


def ms_to_s(ms: Column) -> Column:
    return F.round(ms / 1000, 4)


def short_id(value: Column, bits: int = 64) -> Column:
    return F.substring(F.sha2(value, 256), 1, bits // 4)


def preview(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def sse_event(name: Column) -> Column:
    """A usable event name, stripped, or null if blank or of several lines."""
    flat = F.trim(name)
    return F.when((flat != "") & ~flat.rlike(r"[\r\n]"), flat)


def cursor(header: Column, parameter: Column) -> Column:
    """The header's cursor if it is given, else the parameter's: a whole number from 0 to 2^63-1, or null."""
    raw = F.coalesce(header, parameter)
    return F.when(raw.rlike(r"^\d{1,19}\z"), raw).try_cast("long")


def replay_from(watermark: Column, mode: Column) -> Column:
    """Where a replay starts: 'watermark', 'all' or the last N messages."""
    last = F.when(mode.rlike(r"^\d+\z"), mode).try_cast("long")
    return F.when(mode == "all", F.lit(0).cast("long")).when(last.isNotNull(), F.greatest(F.lit(0).cast("long"), watermark - last)).otherwise(watermark)


def poll_interval(base: Column, higher_busy: Column) -> Column:
    """A consumer polls at a third of its pace while one of higher priority works on its queues."""
    return F.when(higher_busy, base * 3).otherwise(base)


def log_json(severity: Column, component: Column, message: Column) -> Column:
    """A log line as JSON; a line without component has null there."""
    return F.to_json(F.struct(severity.alias("severity"), component.alias("component"), message.alias("message")), {"ignoreNullFields": "false"})


def capsules(spec: Column) -> Column:
    """'q1,q2: n; q3: m' as an array of queue_name, capsule (its place) and threads; if a queue is named twice, of one element that names it as repeated."""
    parts = F.transform(F.split(spec, ";"), lambda part, i: F.struct(i.alias("capsule"), F.split(part, ":").alias("p")))
    queues = lambda x: F.split(F.element_at(x["p"], 1), ",")
    each = lambda x: F.transform(
        queues(x), lambda q: F.struct(F.trim(q).alias("queue_name"), x["capsule"].alias("capsule"), F.trim(F.element_at(x["p"], 2)).cast("int").alias("threads"), F.lit(None).cast("string").alias("repeated"))
    )
    rows = F.flatten(F.transform(parts, each))
    named = F.transform(rows, lambda r: r["queue_name"])
    twice = F.filter(named, lambda q: F.size(F.filter(named, lambda o: o == q)) > 1)
    refused = F.array(F.struct(F.lit(None).cast("string").alias("queue_name"), F.lit(None).cast("int").alias("capsule"), F.lit(None).cast("int").alias("threads"), F.get(twice, F.lit(0)).alias("repeated")))
    return F.when(F.size(twice) > 0, refused).otherwise(rows)


def log_parts(line: Column) -> Column:
    """Component and message of '[Component] message'."""
    component = F.regexp_extract(line, r"^\[([^\]]+)\] ?", 1)
    return F.struct(F.when(component != "", component).alias("component"), F.regexp_replace(line, r"^\[([^\]]+)\] ?", "").alias("message"))
