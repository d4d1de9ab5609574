"""The naming of queues: prefix, dead letters, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest physical name, and the suffix of dead-letter queues.
MAX_NAME = 47
DEAD_LETTERS = "_dlq"
PREFIX = "mq"


def normalize(name: Column) -> Column:
    """A name of word characters alone stays as it is. Of others these characters stay; what separates them (-, ., : and _) is
    one _ for each run, none at the edges.
    """
    separated = F.regexp_replace(F.regexp_replace(name, r"[^\w.:-]", ""), r"[_.:-]+", "_")
    return F.when(name.rlike(r"^\w+\z"), name).otherwise(F.btrim(separated, F.lit("_")))


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\w+\z") & (F.length(name) <= MAX_NAME), F.lit(False))


def physical(logical: Column, prefix: str = PREFIX) -> Column:
    return normalize(F.concat(F.lit(f"{prefix}_"), logical))


def dead_letters(queue: Column) -> Column:
    return F.concat(queue, F.lit(DEAD_LETTERS))


def is_dead_letters(queue: Column) -> Column:
    return queue.endswith(DEAD_LETTERS)


def with_priority(queue: Column, priority: Column, levels: int) -> Column:
    """The sub-queue of a priority; 0 is read first, others are clamped into the levels there are."""
    return F.concat(queue, F.lit("_p"), F.greatest(F.lit(0), F.least(priority, F.lit(levels - 1))).cast("string"))


def logical(queue: Column, prefix: str = PREFIX) -> Column:
    return F.regexp_replace(F.regexp_replace(queue, f"^{prefix}_", ""), r"_p\d+$", "")


def priority_of(queue: Column) -> Column:
    return F.regexp_extract(queue, r"_p(\d+)$", 1).try_cast("int")


def handler_queue(handler_class: Column) -> Column:
    """CamelCase and :: to snake_case: an underscore where a word starts after a small letter or digit, or after capitals."""
    return F.lower(F.regexp_replace(handler_class, "::|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


#: What no table name may hold.
FORBIDDEN = ("$", ";", "--", "'")


def table_name_ok(name: Column) -> Column:
    """Names that may become table names."""
    bad = F.lit(False)
    for part in FORBIDDEN:
        bad = bad | F.contains(name, F.lit(part))
    return ~bad


def advisory_lock(queue: Column) -> Column:
    return F.crc32(queue.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))
